"""Evaluation texts inside training text, by spaced-seed hashing.

Words are runs of letters and digits in lower case. Each window of `span` words of a test item (the whole item if it
has fewer) is hashed once per mask; a mask keeps half of the positions and ignores the rest. The masks for a tolerance
of t substitutions come from 2 t classes of positions, each mask keeping t of them, so whichever t words are substituted
one mask ignores them all, and no such window is missed: two masks for one substitution, six for two. The hashes of both
sides are joined, and around every hit the windows are compared word by word: one counts with at most `tolerance`
substitutions. Exact windows have none.

Where the items are small (MAX_BLOCK_BYTES of text), their hashes are one broadcast table and the join happens inside
Arrow batches of the documents, which are not shuffled. Beyond that nothing of the items is collected or broadcast but
a Bloom filter of bounded size: both sides yield their hashes, those of the documents only where the filter lets them
pass, and a shuffled join brings them together, salted so that a passage half the corpus repeats is spread over tasks.

Whole texts are read. Null texts and items without words match nothing; equal items are each reported.
"""

from __future__ import annotations

import re
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.spans import WordHashes, bloom_filter, bloom_slots
from lontar.util import cut, need, ship

SPAN = 10
MAX_BLOCK_BYTES = 4 << 20
SALTS = 8
COEFFICIENTS = np.random.default_rng(9).integers(1, 1 << 62, 64, dtype=np.int64) | 1
WORD = re.compile(r"[^\W_]+")
SPARE = 32


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def masks(n: int, tolerance: int) -> list[tuple[int, ...]]:
    """The positions that each mask keeps of a window of n words."""
    classes = 2 * max(1, tolerance)
    kept = (tuple(i for i in range(n) if i % classes in c) for c in combinations(range(classes), classes // 2))
    return [m for m in dict.fromkeys(kept) if m]


class Seeds:
    """The hashes of a table of items: per window length and mask, sorted, with the windows they stand for."""

    def __init__(self, items: list[tuple[int, list[str]]], span: int, tolerance: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items, self.ids = [], []
        by_length: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            if words:
                k = len(self.items)
                self.items.append(item)
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
                n = min(span, len(words))
                by_length.setdefault(n, []).extend((k, p) for p in range(len(words) - n + 1))
        self.groups = []
        for n, places in sorted(by_length.items()):
            windows = np.array([self.ids[k][p : p + n] for k, p in places])
            seeds = []
            for mask in masks(n, tolerance):
                h = self.hash(windows.T, mask, len(windows))
                order = np.argsort(h, kind="stable")
                seen = np.zeros(1 << max(10, (len(h) * SPARE).bit_length()), bool)
                seen[self.slot(h, len(seen))] = True
                seeds.append((mask, h[order], order, seen))
            self.groups.append((n, np.array(places), windows, seeds))

    def hash(self, columns, mask, n: int) -> np.ndarray:
        h = np.zeros(n, np.int64)
        for i in mask:
            h += columns[i] * COEFFICIENTS[i]
        return h

    @staticmethod
    def slot(h: np.ndarray, size: int) -> np.ndarray:
        """Places in a table of this size (a power of two) that tells most hashes without an item at once."""
        return ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def matches(self, texts: list[str | None], tolerance: int):
        """(text, item, position in the text, position in the item, length, substitutions) of every verified window."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        get = self.vocabulary.get
        ids = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(words)), counts)
        starts = np.cumsum(counts) - counts
        for n, places, windows, seeds in self.groups:
            m = len(ids) - n + 1
            if m <= 0:
                continue
            columns = [ids[i : i + m] for i in range(n)]
            pairs = []
            for mask, sorted_h, order, seen in seeds:
                h = self.hash(columns, mask, m)
                at = np.flatnonzero(seen[self.slot(h, len(seen))])
                at = at[text[at] == text[at + n - 1]]
                lo, hi = np.searchsorted(sorted_h, h[at]), np.searchsorted(sorted_h, h[at], "right")
                k = hi - lo
                at, first, k = at[k > 0], lo[k > 0], k[k > 0]
                inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                pairs.append(np.stack([np.repeat(at, k), order[np.repeat(first, k) + inner]]))
            at, w = np.unique(np.concatenate(pairs, axis=1), axis=1)
            wrong = np.zeros(len(at), np.int64)
            for i in range(n):
                wrong += ids[at + i] != windows[w, i]
            ok = wrong <= min(tolerance, n - 1)
            at, w, wrong = at[ok], w[ok], wrong[ok]
            for a, p, s in zip(at.tolist(), w.tolist(), wrong.tolist(), strict=True):
                k, q = places[p]
                t = int(text[a])
                yield t, self.items[k], a - int(starts[t]), int(q), n, s


def _finder(block, tolerance: int):
    def run(batches):
        seeds = cloudpickle.loads(block.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            best: dict[tuple, list[int]] = {}
            for t, item, pos, item_pos, n, wrong in seeds.matches(batch.column(1).to_pylist(), tolerance):
                covered = best.setdefault((ids[t], item), [wrong, 0, pos, set(), n])
                covered[0] = min(covered[0], wrong)
                covered[1] += 1
                covered[2] = min(covered[2], pos)
                covered[3].update(range(item_pos, item_pos + n))
            rows = [(d, i, w, c, p, len(s)) for (d, i), (w, c, p, s, _) in best.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]], ["doc_id", "item_id", "substitutions", "windows", "first_word", "item_words"])

    return run


FOUND = "doc_id bigint, item_id bigint, substitutions int, windows int, first_word int, item_words int"
WINDOWS = "n int, mask int, h bigint, key bigint, pos int, words array<string>"


def _windows(lengths: list[int] | None, span: int, tolerance: int, bloom=None):
    """Arrow batches (key, text) to every masked window: of the given lengths, or, for items, of min(span, their words)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            counts = np.array([len(w) for w in words], np.int64)
            flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum())).view(np.int64)
            text, starts = np.repeat(np.arange(len(words)), counts), np.cumsum(counts) - counts
            for n in range(1, span + 1) if lengths is None else lengths:
                m = len(flat) - n + 1
                if m <= 0:
                    continue
                own = text[:m] == text[n - 1 :]
                if lengths is None:
                    own &= np.minimum(counts, span)[text[:m]] == n
                for k, mask in enumerate(masks(n, tolerance)):
                    h = np.full(m, 31 * n + k, np.int64)
                    for i in mask:
                        h += flat[i : i + m] * COEFFICIENTS[i]
                    at = np.flatnonzero(own)
                    if bloom is not None:
                        f = bloom.value
                        a, b = bloom_slots(h[at], len(f) * 8)
                        at = at[((f[a >> 3] >> (a & 7).astype(np.uint8)) & (f[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]
                    t = text[at]
                    p = at - starts[t]
                    cols = [np.full(len(at), n, np.int32), np.full(len(at), k, np.int32), h[at]]
                    rest = [pa.array([keys[i] for i in t.tolist()], pa.int64()), pa.array(p.astype(np.int32)), pa.array([words[i][j : j + n] for i, j in zip(t.tolist(), p.tolist(), strict=True)], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *rest], ["n", "mask", "h", "key", "pos", "words"])

    return run


ship(__name__)


def joined_leaks(docs: DataFrame, items: DataFrame, tolerance: int, span: int) -> DataFrame:
    """As leaks(), by a shuffled join of the hashes of both sides; docs and items are (key, text)."""
    spark = docs.sparkSession
    own = cut(items.mapInArrow(_windows(None, span, tolerance), WINDOWS))
    lengths = sorted(r.n for r in own.select("n").distinct().collect())  # at most span
    keys = cut(own.select("h").distinct())
    bloom = spark.sparkContext.broadcast(bloom_filter(keys, keys.count()))
    near = docs.mapInArrow(_windows(lengths, span, tolerance, bloom), WINDOWS).withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)))
    own = own.select("n", "mask", "h", F.col("key").alias("item_id"), F.col("pos").alias("q"), F.col("words").alias("item_words"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    wrong = F.aggregate(F.zip_with("words", "item_words", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    hit = near.join(own, ["n", "mask", "h", "salt"]).withColumn("wrong", wrong).where(F.col("wrong") <= F.least(F.lit(tolerance), F.col("n") - 1))
    hit = hit.select(F.col("key").alias("doc_id"), "item_id", "n", "pos", "q", "wrong").distinct()
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("q"), F.col("q") + F.col("n") - 1))))
    g = hit.groupBy("doc_id", "item_id").agg(F.min("wrong").alias("substitutions"), F.count("*").cast("int").alias("windows"), F.min("pos").alias("first_word"), F.size(covered).alias("item_words"))
    return g.select("doc_id", "item_id", "substitutions", "windows", "first_word", "item_words")


def leaks(documents: DataFrame, items: DataFrame, tolerance: int = 1, span: int = SPAN, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, substitutions, windows, first_word, item_words): each document with each item it holds a window of.

    substitutions: of the best window; windows: how many match; first_word: where the first stands in the document;
    item_words: how many words of the item lie in matching windows. tolerance: 0, 1 or 2.
    """
    docs = need(documents, [doc_id, text]).where(F.col(text).isNotNull())
    own = need(items, [item_id, text]).where(F.col(text).isNotNull()).distinct()
    if (own.agg(F.sum(F.octet_length(text))).first()[0] or 0) > max_bytes:
        return joined_leaks(docs, own, tolerance, span)
    rows = sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    seeds = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Seeds([(i, words_of(t)) for i, t in rows], span, tolerance)))  # by value: workers need not have this package
    return docs.mapInArrow(_finder(seeds, tolerance), FOUND)
