"""Filling containers of fixed capacity with documents.

Sizes are token counts of a public tokenizer. Documents are spread by a hash of their key over groups of a bounded
number of containers, each group a job of its own: they are laid into containers in the order of the hash (next fit),
which leaves gaps in all of them, and a swap-based local search over the underfull containers does the packing. It takes the emptiest container and gives one document for none
(a move), one for one, or two for one to whichever container gains most, as long as that raises the sum of squared
fills; this drains the emptiest containers into the gaps of the others until they are empty and go. The search ends at
the lower bound (total size over capacity) or at a local optimum, when no exchange of any underfull container raises the
sum; as it rises with every step, it always ends. At the end the emptiest container gives to the others what they can
take, which leaves most of the free space in one. The containers still below FULL then meet in fewer groups, round after
round, until they are one group or a round saves no container. Only keys and sizes are shuffled.

A document above the capacity is cut into pieces of exactly the capacity and a rest; no other is split. Null and empty
texts have no tokens: they are listed without a container. Equal texts under different keys are different items.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.util import cut, need, ship

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizing pattern the vocabulary was made with (a fixed value of that public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_CONTAINERS = 256
FULL = 0.99


def _counter(vocabulary):
    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = encoding.encode_ordinary
        for batch in batches:
            n = [len(count(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens). The vocabulary file is read on the driver and broadcast (under 1 MB)."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    return need(documents, [doc_id, text]).mapInArrow(_counter(vocabulary), "doc_id bigint, tokens bigint")


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the given order: the last one, or a new one if that has no room."""
    place, b, free = np.empty(len(sizes), np.int64), 0, capacity
    for i, s in enumerate(sizes.tolist()):
        if s > free:
            b, free = b + 1, capacity
        free -= s
        place[i] = b
    return place


class LocalSearch:
    """Exchanges between underfull containers that raise the sum of squared fills; place is changed in place."""

    def __init__(self, place: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
        self.place, self.sizes, self.capacity = place, sizes, capacity
        self.fill = np.bincount(place, sizes).astype(np.int64)
        self.bound, self.steps = math.ceil(int(sizes.sum()) / capacity), 0

    def containers(self) -> int:
        return int((self.fill > 0).sum())

    def best_change(self, source: int) -> tuple[list[int], int, int] | None:
        """(items given, item taken or -1, target) of the steepest step from a container; None if none raises the sum.

        Taking d from a to b changes the sum of squares by 2 d (d + fill(b) - fill(a)).
        """
        own = np.flatnonzero(self.place == source)
        targets = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        targets = targets[targets != source]
        under = np.zeros(len(self.fill), bool)
        under[targets] = True
        other = np.flatnonzero(under[self.place])
        size = self.sizes[own]
        i, j = np.triu_indices(len(own), 1)
        given = np.concatenate([size, size[i] + size[j]])
        taken = np.concatenate([np.zeros(len(targets), np.int64), self.sizes[other]])
        target = np.concatenate([targets, self.place[other]])
        given = given[given - taken.max(initial=0) <= self.capacity]  # pairs too large for any exchange
        d = given[:, None] - taken
        d[len(size) :, : len(targets)] = 0  # a move takes one item
        fill = self.fill[target]
        gain = np.where((d > 0) & (d <= self.capacity - fill), d * (d + (fill - self.fill[source])), 0)
        if not gain.size or gain.max() <= 0:
            return None
        k, m = np.unravel_index(int(np.argmax(gain)), gain.shape)
        items = [own[k]] if k < len(size) else [own[i[k - len(size)]], own[j[k - len(size)]]]
        return items, int(other[m - len(targets)]) if m >= len(targets) else -1, int(target[m])

    def drain(self, source: int) -> bool:
        """Steps from a container until none raises the sum or it is empty; whether there was any."""
        before = self.steps
        while 0 < self.fill[source] < self.capacity and (change := self.best_change(source)):
            items, back, target = change
            d = int(self.sizes[items].sum()) - (int(self.sizes[back]) if back >= 0 else 0)
            self.place[items] = target
            if back >= 0:
                self.place[back] = source
            self.fill[source] -= d
            self.fill[target] += d
            self.steps += 1
        return self.steps > before

    def underfull(self) -> list[int]:
        """The emptiest first."""
        under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        return under[np.argsort(self.fill[under], kind="stable")].tolist()

    def run(self) -> None:
        changed = True
        while changed and self.containers() > self.bound:
            changed = False
            for source in self.underfull():
                changed |= self.drain(source)
                if changed and self.fill[source] == 0:
                    break  # the emptiest of those left is next
        for source in self.underfull()[:1]:  # at the bound, what is free goes into one container, so that the others are done
            self.drain(source)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered without gaps."""
    place = next_fit(sizes, capacity)
    LocalSearch(place, sizes, capacity).run()
    return np.unique(place, return_inverse=True)[1]


def _packer(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["h", "doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].to_numpy(np.int64)
        place = pack(sizes, capacity)
        g = int(pdf["grp"].iloc[0])
        filled = np.bincount(place, sizes).astype(np.int64)[place]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "tokens": sizes, "container": [f"{g:x}-{k:x}" for k in place.tolist()], "filled": filled})

    return run


ship(__name__)

PACKED = "doc_id bigint, piece_no int, tokens bigint, container string, filled bigint"


def _packed(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """One job per group; the number of partitions is fixed, so adaptive execution does not join small groups into one task."""
    h = F.xxhash64("doc_id", "piece_no")
    spread = items.withColumn("h", h).withColumn("grp", F.pmod(h, F.lit(groups)).cast("bigint")).repartition(min(groups, max(200, groups // 64)), "grp")
    return spread.groupBy("grp").applyInPandas(_packer(capacity), PACKED)


def fill_containers(counts: DataFrame, capacity: int = CAPACITY, group_containers: int = GROUP_CONTAINERS) -> DataFrame:
    """counts(doc_id, tokens) -> (container, doc_id, piece_no, start, tokens, filled).

    start: where the piece begins in the document, in tokens; filled: tokens in the container. Each row of counts is
    one item (give one row per document).
    """
    counts = cut(need(counts, ["doc_id", "tokens"]))
    empty = counts.where("coalesce(tokens, 0) <= 0").select(F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("filled"))
    some = counts.where("tokens > 0")
    whole = some.where(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.expr(f"tokens div {capacity}") - 1).cast("int"))).alias("piece_no"))
    whole = whole.select(F.concat(F.lit("w-"), F.hex("doc_id"), F.lit("-"), "piece_no").alias("container"), "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("tokens"), F.lit(capacity).cast("bigint").alias("filled"))
    rest = some.select("doc_id", F.expr(f"CAST(tokens div {capacity} AS INT)").alias("piece_no"), (F.col("tokens") % capacity).alias("tokens")).where("tokens > 0")
    full = math.ceil(FULL * capacity)
    done, k, before = None, 0, None
    while True:
        total = rest.agg(F.sum("tokens")).first()[0] or 0
        groups = max(1, math.ceil(total / capacity / group_containers))
        packed = cut(_packed(rest, groups, capacity).withColumn("container", F.concat(F.lit(f"{k}-"), "container")))
        left = packed.where(F.col("filled") < full)
        last = groups == 1 or before is not None and packed.select("container").distinct().count() >= before
        keep = packed if last else packed.where(F.col("filled") >= full)
        done = keep if done is None else done.unionByName(keep)
        if last:
            break
        rest, before, k = left.select("doc_id", "piece_no", "tokens"), left.select("container").distinct().count(), k + 1
    done = done.select("container", "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), "tokens", "filled")
    return done.unionByName(whole).unionByName(empty)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, lower_bound, tokens, unused, overfull, documents, split): one row on the result of fill_containers().

    lower_bound: containers that the tokens need at least; unused: free tokens of all containers; overfull: containers
    above the capacity; split: documents in pieces that would have fitted into one container.
    """
    per = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("t"))
    c = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count_if(F.col("t") > capacity).alias("overfull"))
    d = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= capacity)).alias("split"))
    one = c.crossJoin(F.broadcast(d))  # one row each
    return one.select("containers", F.expr(f"(tokens + {capacity - 1}) div {capacity}").alias("lower_bound"), "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), "overfull", "documents", "split")
