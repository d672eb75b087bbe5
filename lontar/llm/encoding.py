"""Text garbled by a wrong character encoding: finding it and restoring what was written.

Damage is modelled as chains: bytes of one encoding read as another, once or several times over. For each value every
chain is undone where it can be, per stretch of characters that could have come from it, and the result is scored
against the value as it stands by a smoothed character trigram model of clean records. The likeliest chain is accepted
if a stretch gains more in log-likelihood than a margin; this repeats until nothing gains (so doubly damaged text unwinds step
by step). The margin is validated on all clean records: in each a word is damaged by one chain and restored, and the margin is
set between the gains of honest text and those of damaged text. Values without two neighbouring characters beyond
ASCII never leave the JVM, and of the others those without two that some chain could explain are not searched.

The model is trained on all clean records (no U+FFFD, no C1 control, no stretch that plainly comes from a chain). Its
counts live in tables of fixed size (hashed n-grams, 5 MB), which bounds what is collected and broadcast.

Cases: a value with an accepted chain, or with U+FFFD or a C1 control, which no honest text holds. Null and empty
values are none. Lost characters (U+FFFD) stay as they are in the restored text, which is then marked incomplete;
from_versions() fills them from other versions of the same text.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.util import ship

#: Encodings that UTF-8 bytes get read as. cp1252 here also holds Latin-1's C1 controls, for the bytes it leaves undefined.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1256", "koi8_r")
#: One-byte encodings whose bytes get read as cp1252 or Latin-1.
WRITTEN_IN = ("cp1256", "iso8859_6", "cp1251", "koi8_r", "cp1253")
BITS = (16, 18, 20)
BOUND = "\x02\x02"
MAX_DEPTH, BEAM, STEP = 4, 4, 2.0
BAD = re.compile("[\x80-\x84\x86-\x9f�]")
BUCKETS = 400
SHORT = 40


def byte_map(encoding: str) -> dict[str, int]:
    """Character -> byte (0x80 and up) of a one-byte encoding."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def suspicious() -> str:
    """A pattern of two characters that some chain could explain, or one that no honest text holds.

    A text without it has no stretch for any chain.
    """

    def some(m: dict[str, int], lo: int, hi: int) -> str:
        return "[" + "".join(f"\\u{ord(c):04x}" for c, b in m.items() if lo <= b <= hi) + "]"

    maps = {e: byte_map(e) for e in READ_AS}
    pairs = [some(m, 0xC2, 0xF4) + some(m, 0x80, 0xBF) for m in maps.values()]
    return "|".join([*pairs, some(maps["cp1252"], 0x80, 0xFF) + "{2}", r"[\u0080-\u0084\u0086-\u009f\ufffd]"])


class Chains:
    """The stretches of a text that each chain could explain, and what was there before."""

    def __init__(self) -> None:
        self.maps = {e: byte_map(e) for e in READ_AS}
        self.utf8 = {e: self._sequences(m) for e, m in self.maps.items()}
        self.plainly = {e: self._plainly(m) for e, m in self.maps.items()}
        self.leads = {e: frozenset(c for c, b in m.items() if b >= 0xC2) for e, m in self.maps.items()}
        high = "".join(re.escape(c) for c in self.maps["cp1252"])
        self.run = re.compile(f"[{high}]{{2,}}")
        self.names = [*(f"utf8>{e}" for e in READ_AS), *(f"{e}>cp1252" for e in WRITTEN_IN)]
        self.suspect = re.compile(suspicious())

    @staticmethod
    def _chars(m: dict[str, int], lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi) + "]"

    def _sequences(self, m: dict[str, int]) -> re.Pattern:
        c = self._chars(m, 0x80, 0xBF)
        return re.compile(f"(?:{self._chars(m, 0xC2, 0xDF)}{c}|{self._chars(m, 0xE0, 0xEF)}{c}{c}|{self._chars(m, 0xF0, 0xF4)}{c}{c}{c})+")

    def _plainly(self, m: dict[str, int]) -> re.Pattern:
        """Stretches that chance hardly makes: two sequences in a row, one of three bytes, or one that stands for a Latin letter or sign."""
        c = self._chars(m, 0x80, 0xBF)
        return re.compile(f"(?:{self._chars(m, 0xC2, 0xDF)}{c}){{2}}|{self._chars(m, 0xE0, 0xEF)}{c}{c}|{self._chars(m, 0xC2, 0xC5)}{c}")

    def stretches(self, text: str, name: str, chars: set[str]):
        """(start, end, original) of each stretch the chain could explain; chars: those of the text."""
        first, second = name.split(">")
        if self.leads[second].isdisjoint(chars):
            return
        if first == "utf8":
            m = self.maps[second]
            for x in self.utf8[second].finditer(text):
                try:
                    yield x.start(), x.end(), bytes(m[c] for c in x[0]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
        else:
            m = self.maps["cp1252"]
            for x in self.run.finditer(text):
                try:
                    back = bytes(m[c] for c in x[0]).decode(first)
                except UnicodeDecodeError:
                    continue
                if back != x[0]:
                    yield x.start(), x.end(), back

    def damage(self, text: str, name: str) -> str | None:
        """The text as the chain would have garbled it, or None if the chain cannot hold it."""
        first, second = name.split(">")
        inverse = {b: c for c, b in self.maps[second].items()} if second != "cp1252" else {b: c for c, b in sorted(self.maps["cp1252"].items(), reverse=True)}
        try:
            data = text.encode("utf-8" if first == "utf8" else first)
        except UnicodeEncodeError:
            return None
        return "".join(chr(b) if b < 0x80 else inverse[b] for b in data)

    def is_clean(self, text: str) -> bool:
        if text.isascii():
            return True
        chars = set(text)
        return not (BAD.search(text) or any(p.search(text) for e, p in self.plainly.items() if not self.leads[e].isdisjoint(chars)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def slots(cp: np.ndarray) -> list[np.ndarray]:
    """Table slots of the 1-, 2- and 3-gram that ends at each position from the third on."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    keys = (c, b * np.uint64(1 << 21) + c, (a * np.uint64(1 << 42)) ^ (b * np.uint64(1 << 21)) ^ c)
    return [(((k + np.uint64(n)) * mix) >> np.uint64(64 - BITS[n])).astype(np.int64) for n, k in enumerate(keys)]


def slot(key: int, n: int) -> int:
    """As slots(), of one key."""
    return (((key + n) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS[n])


class Trigrams(dict):
    """Log-likelihoods of the last characters of trigrams; cleared at a fixed size."""

    def __init__(self, model: NGramModel) -> None:
        self.model = model

    def __missing__(self, abc: str) -> float:
        if len(self) > 500_000:
            self.clear()
        (t1, t2, t3), w, total = self.model.views, self.model.weight, self.model.total
        a, b, c = map(ord, abc)
        ab = t2[slot((a << 21) + b, 1)]
        p = (t1[slot(c, 0)] + 1e-2) / (total + 1e4)
        p = (t2[slot((b << 21) + c, 1)] + w * p) / (t1[slot(b, 0)] + w)
        v = self[abc] = math.log((min(t3[slot((a << 42) ^ (b << 21) ^ c, 2)], ab) + w * p) / (ab + w))
        return v


class NGramModel:
    """Interpolated character trigrams over hashed counts."""

    def __init__(self, tables: list[np.ndarray], weight: float = 2.0) -> None:
        self.t, self.weight, self.total = tables, weight, float(tables[0].sum()) + 1.0
        self.views = [memoryview(np.ascontiguousarray(t, np.float64)) for t in tables]
        self.cache: dict[str, float] = {}
        self.trigrams = Trigrams(self)

    def log_likelihood(self, text: str) -> float:
        """Of the text after its first two characters."""
        v = self.cache.get(text)
        if v is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            v = self.cache[text] = self._score(text) if len(text) > SHORT else self._score_short(text)
        return v

    def _score_short(self, text: str) -> float:
        """As _score(), from the trigrams seen before: quicker for a few characters."""
        return sum(map(self.trigrams.__getitem__, map("".join, zip(text, text[1:], text[2:]))))

    def whole(self, text: str) -> float:
        return self._score(BOUND + text + BOUND)

    def _score(self, text: str) -> float:
        cp = code_points(text)
        if len(cp) < 3:
            return 0.0
        one, two, three = slots(cp)
        # counts of the contexts: the bigram (a, b) ends one position earlier, the unigram b as well
        before = slots(np.concatenate([np.array([2], np.uint64), cp[:-1]]))
        w = self.weight
        p1 = (self.t[0][one] + 1e-2) / (self.total + 1e4)
        p2 = (self.t[1][two] + w * p1) / (self.t[0][before[0]] + w)
        p3 = (np.minimum(self.t[2][three], self.t[1][before[1]]) + w * p2) / (self.t[1][before[1]] + w)
        return float(np.log(p3).sum())

    def gain(self, text: str, start: int, end: int, original: str) -> float:
        left, right = (BOUND + text[max(0, start - 2) : start])[-2:], text[end : end + 2]
        return self.log_likelihood(left + original + right) - self.log_likelihood(left + text[start:end] + right)


def restore(text: str, chains: Chains, model: NGramModel, margin: float) -> tuple[str, list[str], float]:
    """(restored text, accepted chains, best gain of a stretch as the text stands).

    A chain is accepted if one of its stretches gains more than the margin; it then restores all its stretches that
    gain. The likeliest BEAM sequences of chains are followed, and the one whose result is likeliest is taken; each step
    more costs STEP.
    """
    first = float("-inf")
    best: tuple[float, str, list[str]] = (0.0, text, [])
    states, seen, base = [best], {text}, None
    for depth in range(MAX_DEPTH):
        after = []
        for _, now, names in states:
            if not chains.suspect.search(now):
                continue
            chars = set(now)
            for name in chains.names:
                most, at, out = float("-inf"), 0, []
                for start, end, original in chains.stretches(now, name, chars):
                    g = model.gain(now, start, end, original)
                    most = max(most, g)
                    if g > 0:
                        out += [now[at:start], original]
                        at = end
                if depth == 0:
                    first = max(first, most)
                if most > margin and out and (new := "".join(out) + now[at:]) not in seen:
                    seen.add(new)
                    base = model.whole(text) if base is None else base
                    after.append((model.whole(new) - base - STEP * len(names), new, [*names, name]))
        if not after:
            break
        states = sorted(after, key=lambda x: -x[0])[:BEAM]
        if states[0][0] > best[0]:
            best = states[0]
    return best[1], best[2], first


def _count(batches):
    chains = Chains()
    tables = [np.zeros(1 << b, np.int64) for b in BITS]
    for batch in batches:
        texts = [x for x in batch.column(0).to_pylist() if x and chains.is_clean(x)]
        if not texts:
            continue
        for k, s in enumerate(slots(code_points(BOUND + BOUND.join(texts)))):
            tables[k] += np.bincount(s, minlength=1 << BITS[k])
    for k, t in enumerate(tables):
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["k", "slot", "n"])


def _validator(tables, chains_of=Chains):
    def run(batches):
        chains, model = chains_of(), NGramModel(tables.value)
        honest, damaged = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        place = lambda g: int(min(BUCKETS - 1, max(0, g * 2 + BUCKETS // 4)))
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if not x or x.isascii() or not chains.is_clean(x):
                    continue
                if chains.suspect.search(x) and (g := restore(x, chains, model, float("inf"))[2]) > float("-inf"):
                    honest[place(g)] += 1
                m = max(re.findall(r"[^\x00-\x7f]+", x), key=len)
                at = x.find(m)
                h = zlib.crc32(x.encode())
                for k in range(len(chains.names)):
                    name = chains.names[(h + k) % len(chains.names)]
                    d = chains.damage(m, name)
                    if d is not None and d != m:
                        t = x[max(0, at - 4) : at] + d + x[at + len(m) : at + len(m) + 4]
                        damaged[place(restore(t, chains, model, float("inf"))[2])] += 1
                        break
        for k, t in enumerate((honest, damaged)):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["k", "slot", "n"])

    return run


def choose_margin(honest: np.ndarray, damaged: np.ndarray) -> float:
    """The gain between the two histograms at which the share of wrong decisions on either side is least; ties go to the middle."""
    wrong = (honest[::-1].cumsum()[::-1] - honest) / max(1, honest.sum()) + damaged.cumsum() / max(1, damaged.sum())
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    least = least[least >= BUCKETS // 4]
    at = int(least[len(least) // 2]) if len(least) else BUCKETS // 4
    return max(1.0, (at + 1 - BUCKETS // 4) / 2)


def train(values: DataFrame, text: str) -> tuple[list[np.ndarray], float]:
    """(count tables, margin) from all clean records of a column."""
    one = values.select(text).where(F.col(text) != "")
    tables = [np.zeros(1 << b) for b in BITS]
    for r in one.mapInArrow(_count, "k int, slot int, n bigint").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas().itertuples():
        tables[r.k][r.slot] = r.n
    sent = values.sparkSession.sparkContext.broadcast(tables)
    parts = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for r in one.mapInArrow(_validator(sent), "k int, slot int, n bigint").groupBy("k", "slot").agg(F.sum("n").alias("n")).collect():
        parts[r.k][r.slot] = r.n
    return tables, choose_margin(*parts)


def _restorer(tables, margin):
    def run(batches):
        chains, model = Chains(), NGramModel(tables.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            keep, out, names, whole = [], [], [], []
            for i, x in enumerate(texts):
                if not x or not chains.suspect.search(x):
                    continue
                back, accepted, _ = restore(x, chains, model, margin)
                if accepted or BAD.search(x):
                    keep.append(i)
                    out.append(back)
                    names.append(" ".join(accepted))
                    whole.append(not BAD.search(back))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(out, pa.string()), pa.array(names, pa.string()), pa.array(whole, pa.bool_())], [*batch.schema.names[:-1], "restored", "chains", "complete"])

    return run


def damaged(values: DataFrame, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """The damaged rows of values: its other columns, restored, chains (as accepted, in order) and complete.

    The model is trained on the same column of corpus, if that is given, else on values. A column of values that bears
    the name of one of these results is left out.
    """
    values = values.drop(*({"restored", "chains", "complete"} - {text}))
    tables, margin = train(values if corpus is None else corpus, text)
    keys = [c for c in values.columns if c != text]
    sent = values.sparkSession.sparkContext.broadcast(tables)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema if f.name != text)
    near = F.col(text).rlike(r"[^\x00-\x7f]{2}|[\x80-\x84\x86-\x9f\uFFFD]")  # no chain explains less; the JVM tells most texts by it
    return values.select(*keys, text).where(near).mapInArrow(_restorer(sent, margin), f"{fields}, restored string, chains string, complete boolean")


def from_versions(lost: DataFrame, clean: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """(row, found): the wording of rows with lost characters where exactly one clean text of the same keys fits.

    lost(*keys, *row, restored), clean(*keys, text). Each run of U+FFFD may stand for up to three characters each. Rows
    and texts meet by keys and three undamaged words at the start, the end or in the middle, so even a key that holds a
    third of all rows yields few comparisons; rows damaged in all three places are left.
    """
    words = lambda c: F.split(c, " ")
    head = lambda c: F.concat(F.lit("h "), F.array_join(F.slice(words(c), 1, 3), " "))
    tail = lambda c: F.concat(F.lit("t "), F.array_join(F.slice(words(c), F.greatest(F.size(words(c)) - 2, F.lit(1)), 3), " "))
    middle = lambda c: F.concat(F.lit("m "), F.array_join(F.slice(words(c), F.greatest(F.floor(F.size(words(c)) / 2).cast("int"), F.lit(1)), 3), " "))
    r, gone = F.col("restored"), "�"
    end = F.coalesce(*[F.when(~F.contains(x(r), F.lit(gone)), x(r)) for x in (head, tail, middle)])
    plain = F.regexp_replace(r, r"([%_\\])", r"\\$1")
    n = F.length(r) - F.length(F.replace(r, F.lit(gone), F.lit("")))
    a = lost.select(*keys, *row, end.alias("_end"), F.regexp_replace(plain, f"{gone}+", "%").alias("_like"), (F.length(r) - n).alias("_lo"), (F.length(r) + 2 * n).alias("_hi")).where("_end IS NOT NULL")
    t = F.col("text")
    b = clean.where(t.isNotNull() & ~F.contains(t, F.lit(gone))).select(*keys, "text", F.explode(F.array(head(t), tail(t), middle(t))).alias("_end")).distinct()
    fits = a.join(b, [*keys, "_end"]).where(F.expr("text LIKE _like") & F.length("text").between(F.col("_lo"), F.col("_hi")))
    return fits.groupBy(*row).agg(F.countDistinct("text").alias("_n"), F.min("text").alias("found")).where("_n = 1").select(*row, "found")


ship(__name__)
