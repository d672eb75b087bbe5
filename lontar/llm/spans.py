"""Long exact spans shared between records, by a log-structured fingerprint index.

Every run of `window` consecutive words has a 64-bit hash. A batch of records becomes one immutable run of the index:
per hash the lowest and highest record that holds it (aggregated within Arrow batches before the shuffle, so wording
that a third of all records repeat is a row per some thousand records), bucketed by hash and sorted. A new batch is merge-joined with each
earlier run, bucket by bucket and without a shuffle of the runs; a hash is shared if two different records hold it, in
whichever runs. When the runs exceed `fanout`, they are compacted into one.

The index is a folder: runs and a manifest that names them, replaced as a whole by each append() and compact(), so it
outlasts the job, and a later one that opens it reads its own batch and the runs, never the old texts. Where a table
comes with its history, extend() fingerprints all its batches in one pass and writes their runs together.

Verification goes back to the words: the records are read again, those windows whose hash is in a Bloom filter of the
shared hashes (bounded by MAX_BLOOM_BITS) yield a 128-bit digest of their words, and only a digest that two different
records hold counts. Beyond MAX_SHARED hashes a filter of that size would let too much pass: then the windows are cut
to the shared ones by a join of their hashes first, and only those are digested. Windows that survive are merged into
stretches.

Words are what Unicode white space separates; case and punctuation must agree. Null and short texts have no window. A
record delivered again is the same record, also across batches. A repetition inside one record is not shared.
"""

from __future__ import annotations

import json
import math
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.util import cut, fresh_path, need, ship

WINDOW = 20
MAX_BLOOM_BITS = 1 << 28
MAX_SHARED = MAX_BLOOM_BITS // 8
BLOCK_BYTES = 1 << 13
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
MAX_WORDS_KEPT = 500_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def windows(texts: list[str | None], window: int, hashes: WordHashes):
    """(words of each text, index of the text, position, hash) of every window of a batch."""
    words = [t.split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    if total < window:
        return words, *(np.zeros(0, np.int64),) * 3
    w = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
    power = np.ones(total, np.uint64)
    power[1:] = BASE
    inverse = np.ones(total, np.uint64)
    inverse[1:] = BASE_INVERSE
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power)])
    per = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(words)), per)
    starts = np.cumsum(counts) - counts
    pos = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    at = starts[text] + pos
    h = (sums[at + window] - sums[at]) * inverse[at]
    h = (h ^ (h >> np.uint64(31))) * MIX
    return words, text, pos, (h ^ (h >> np.uint64(29))).view(np.int64)


def _fingerprints(window: int, positions: bool = False):
    """Arrow batches (rec, batch or nothing, text) to the windows: (batch, h, lowest and highest rec) of an Arrow batch, or, with positions, (h, rec, pos)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rec = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            _, text, pos, h = windows(batch.column(batch.num_columns - 1).to_pylist(), window, hashes)
            if positions:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rec[text]), pa.array(pos.astype(np.int32))], ["h", "rec", "pos"])
            else:
                number = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int32)[text]
                for k in np.unique(number):
                    own = np.flatnonzero(number == k)
                    own = own[np.argsort(h[own], kind="stable")]
                    first = np.flatnonzero(np.concatenate([[True], h[own[1:]] != h[own[:-1]]]))
                    r = rec[text[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(h[own[first]]), pa.array(np.minimum.reduceat(r, first)), pa.array(np.maximum.reduceat(r, first))], ["batch", "h", "lo", "hi"])

    return run


def bloom_slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    a = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(bits)))
    b = (u * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - int(math.log2(bits)))
    return a.astype(np.int64), b.astype(np.int64)


def bloom_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """Bytes of a Bloom filter with 8 to 16 bits a key, at most MAX_BLOOM_BITS / 8 bytes.

    The bits are shuffled by block and each block is set in one task, so a task sends no more than its blocks.
    """
    bits = max(BLOCK_BYTES * 8, min(MAX_BLOOM_BITS, 1 << math.ceil(math.log2(max(1, n) * 8))))

    def place(batches):
        for batch in batches:
            s = np.concatenate(bloom_slots(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((s // (BLOCK_BYTES * 8)).astype(np.int32)), pa.array((s % (BLOCK_BYTES * 8)).astype(np.int32))], ["block", "bit"])

    def join(pdf):
        f = np.zeros(BLOCK_BYTES * 8, bool)
        f[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [np.packbits(f, bitorder="little").tobytes()]})

    out = np.zeros((bits // 8 // BLOCK_BYTES, BLOCK_BYTES), np.uint8)
    for r in hashes.select("h").mapInArrow(place, "block int, bit int").distinct().groupBy("block").applyInPandas(join, "block int, data binary").collect():
        out[r.block] = np.frombuffer(r.data, np.uint8)
    return out.reshape(-1)


def _digests(window: int, bloom=None):
    """Digests of the windows a filter lets pass, of batches (rec, text), or of given ones, of batches (rec, text, positions)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rec = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            if bloom is not None:
                words, text, pos, h = windows(batch.column(1).to_pylist(), window, hashes)
                f = bloom.value
                a, b = bloom_slots(h, len(f) * 8)
                keep = ((f[a >> 3] >> (a & 7).astype(np.uint8)) & (f[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
                text, pos = text[keep], pos[keep]
            else:
                words = [t.split() for t in batch.column(1).to_pylist()]
                at = batch.column(2).to_pylist()
                text = np.repeat(np.arange(len(at)), [len(p) for p in at])
                pos = np.fromiter(chain.from_iterable(at), np.int64, len(text))
            digest = np.empty((len(text), 2), np.uint64)
            size = np.empty(len(text), np.int32)
            for i, (t, p) in enumerate(zip(text.tolist(), pos.tolist(), strict=True)):
                w = words[t]
                size[i] = len(w)
                d = xxhash.xxh3_128_intdigest(" ".join(w[p : p + window]).encode("utf-8", "surrogatepass"))
                digest[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
            d = np.ascontiguousarray(digest.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[0]), pa.array(d[1]), pa.array(rec[text]), pa.array(pos.astype(np.int32)), pa.array(size)], ["d1", "d2", "rec", "pos", "n_words"])

    return run


ship(__name__)


RUN = "h bigint, lo bigint, hi bigint"


class SpanIndex:
    """Runs of window hashes in a folder; append() and extend() return the hashes that new batches made shared."""

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = WINDOW, fanout: int = 8, buckets: int | None = None) -> None:
        self.spark, self.window, self.fanout = spark, window, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = (root or fresh_path(spark, "span-index")).rstrip("/")
        self.runs: list[str] = []
        self.version = 0
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> SpanIndex:
        """The index as the last complete manifest of the folder names it."""
        index = cls(spark, root)
        path = index._jvm.Path(f"{index.root}/manifests")
        known = sorted((int(f.getPath().getName().split(".")[0]), f.getPath().toString()) for f in index._fs.listStatus(path)) if index._fs.exists(path) else []
        if not known:
            raise FileNotFoundError(f"no span index in {root}")
        m = json.loads("".join(r.value for r in spark.read.text(known[-1][1]).collect()))
        index.version, index.window, index.fanout, index.buckets, index.runs = known[-1][0], m["window"], m["fanout"], m["buckets"], m["runs"]
        return index

    def _commit(self, runs: list[str]) -> None:
        """Writes the next manifest beside its place and moves it there; folders that it no longer names are deleted after."""
        body = json.dumps({"window": self.window, "fanout": self.fanout, "buckets": self.buckets, "runs": runs})
        self.version += 1
        self._fs.mkdirs(self._jvm.Path(f"{self.root}/manifests"))
        draft, place = self._jvm.Path(f"{self.root}/draft-{uuid.uuid4().hex[:8]}"), self._jvm.Path(f"{self.root}/manifests/{self.version:08d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        if not self._fs.rename(draft, place):
            raise RuntimeError(f"{self.root} has been changed by another writer")
        self.runs = runs

    def _write(self, summary: DataFrame, by: list[str]) -> str:
        """The folder of a run, or, by batch, of the folders of several; the table is only the way to write buckets."""
        name = f"lontar_spans_{uuid.uuid4().hex[:12]}"
        w = summary.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").option("compression", "zstd")
        try:
            (w.partitionBy(*by) if by else w).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay
        return name

    def run(self, folder: str) -> DataFrame:
        """A run as a bucketed table."""
        name = f"lontar_run_{uuid.uuid4().hex[:12]}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
        try:
            return self.spark.sql(f"SELECT * FROM {name}")
        finally:
            self._names = [*getattr(self, "_names", []), name]

    def _summary(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """One row a hash, in the partition of its bucket; hi is null where one record holds it. One shuffle serves both."""
        g = rows.repartition(self.buckets, "h").groupBy(*keys, "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return g.select("h", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).alias("hi"), *keys)

    def append(self, records: DataFrame) -> DataFrame:
        """records(rec BIGINT, text), one batch. (h): hashes shared within it or with an earlier run."""
        return self.extend(records.withColumn("batch", F.lit(0)))

    def extend(self, records: DataFrame) -> DataFrame:
        """records(rec BIGINT, batch INT, text), read once. (h): hashes shared within any batch, with an earlier one or a run."""
        rows = records.where("rec IS NOT NULL AND text IS NOT NULL").select("rec", "batch", "text").mapInArrow(_fingerprints(self.window), "batch int, h bigint, lo bigint, hi bigint")
        folder = self._write(self._summary(rows, ["batch"]), ["batch"])
        path = self._jvm.Path(f"{self.root}/{folder}")
        new = sorted((int(f.getPath().getName().split("=")[1]), f"{folder}/{f.getPath().getName()}") for f in self._fs.listStatus(path) if f.getPath().getName().startswith("batch="))
        shared = self.spark.createDataFrame([], "h bigint")
        runs = list(self.runs)
        for _, name in new:
            now = self.run(name)
            shared = shared.unionByName(now.where("hi IS NOT NULL").select("h"))
            for old in runs:
                o = self.run(old).select("h", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
                lo, hi = F.least("lo", "lo2"), F.greatest("lo", "lo2", "hi", "hi2")
                shared = shared.unionByName(now.hint("merge").join(o, "h").where(lo < hi).select("h"))
            runs.append(name)
        shared = cut(shared.distinct())
        self._commit(runs)
        self.compact()
        return shared

    def compact(self) -> None:
        """Merges all runs into one if there are more than fanout."""
        if len(self.runs) <= self.fanout:
            return
        rows = None
        for name in self.runs:
            r = self.run(name).select("h", "lo", F.coalesce("hi", "lo").alias("hi"))
            rows = r if rows is None else rows.unionByName(r)
        merged, old = self._write(self._summary(rows, []), []), self.runs
        self._commit([merged])
        self.close()
        for name in old:
            self._fs.delete(self._jvm.Path(f"{self.root}/{name}"), True)

    def close(self) -> None:
        """Takes the tables of the runs out of the catalogue; their files stay."""
        for name in getattr(self, "_names", []):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = []

    def delete(self) -> None:
        self.close()
        self._fs.delete(self._jvm.Path(self.root), True)


def verified(records: DataFrame, shared: DataFrame, window: int = WINDOW, max_shared: int = MAX_SHARED) -> DataFrame:
    """(rec, pos, n_words): the windows of records(rec, text) with a shared hash (h) whose words another record holds as well."""
    spark = records.sparkSession
    n = shared.count()
    texts = records.where("rec IS NOT NULL AND text IS NOT NULL").select("rec", "text")
    schema = "d1 bigint, d2 bigint, rec bigint, pos int, n_words int"
    if n <= max_shared:
        found = texts.mapInArrow(_digests(window, spark.sparkContext.broadcast(bloom_filter(shared, n))), schema)
    else:
        texts = texts.distinct()
        held = texts.mapInArrow(_fingerprints(window, True), "h bigint, rec bigint, pos int").join(shared, "h", "left_semi").groupBy("rec").agg(F.collect_set("pos").alias("at"))
        found = texts.join(held, "rec").select("rec", "text", "at").mapInArrow(_digests(window), schema)
    found = cut(found)
    several = found.groupBy("d1", "d2").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo < hi").select("d1", "d2")
    return found.join(several, ["d1", "d2"], "left_semi").select("rec", "pos", "n_words")


def shared_windows(records: DataFrame, time: str, window: int = WINDOW, fanout: int = 8, max_shared: int = MAX_SHARED) -> DataFrame:
    """(rec, pos, n_words): every window, by the position of its first word, that another record holds as well.

    The records, of which each year of `time` is a batch (those without one come first), go into an index of their own.
    """
    records = need(records, ["rec", "text", time])
    index = SpanIndex(records.sparkSession, None, window, fanout)
    shared = index.extend(records.select("rec", F.coalesce(F.year(time), F.lit(0)).alias("batch"), "text"))
    index.delete()
    return verified(records, shared, window, max_shared)


def stretches(shared: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rec, n_words, n_shared, stretches): per record its words, how many of them lie in shared stretches, and those as (start, words)."""
    g = shared.groupBy("rec").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("pos")).alias("p"))
    empty = F.array().cast("array<struct<start:int,words:int>>")

    def add(acc, p):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (p <= last.start + last.words)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), (p + window - last.start).alias("words"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct(p.alias("start"), F.lit(window).alias("words")))))

    g = g.withColumn("stretches", F.aggregate("p", empty, add))
    return g.select("rec", "n_words", F.aggregate("stretches", F.lit(0), lambda a, s: a + s.words).alias("n_shared"), "stretches")
