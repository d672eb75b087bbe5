"""Keyed state over an append-only event log. Batch and stream share the same merge functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lontar.operators.windows import last_wins, top_n

KEYS, ORDER = ["user_id", "event_type"], ["ts", "event_id"]


def merge(state: DataFrame, batch: DataFrame, keys: list[str] = KEYS, order: list[str] = ORDER) -> DataFrame:
    """State after a batch of upserts: per key the row that is last by `order`; a late row never wins over a newer one."""
    return last_wins(state.unionByName(batch.select(*state.columns)), keys, order)


def insert_or_ignore(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch under keys the state lacks, one per key, beside the state."""
    return state.unionByName(batch.select(*state.columns).dropDuplicates(keys).join(state.select(*keys), keys, "left_anti").select(*state.columns))


def purge(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Without the rows of these keys."""
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def profiles(events: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, top, events, last_ts): the k most frequent event types of each user, from the full log."""
    c = events.groupBy("user_id", "event_type").agg(F.count("*").alias("k"), F.max("ts").alias("t"))
    totals = c.groupBy("user_id").agg(F.sum("k").alias("events"), F.max("t").alias("last_ts"))
    top = top_n(c, ["user_id"], [F.col("k").desc(), F.col("event_type")], k).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x.event_type), ",").alias("top"))
    return top.join(totals, "user_id").select("user_id", "top", "events", "last_ts")


def refresh(old: DataFrame, events: DataFrame) -> DataFrame:
    """Profiles by a high-water mark: users without an event later than their last_ts keep the old profile; the others, and new users, are computed from the full log. refreshed tells which."""
    kept = old.select("user_id", *[F.col(c).alias(f"_{c}") for c in ("top", "events", "last_ts")])
    newest = events.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max("ts").alias("_n"), F.lit(True).alias("_seen"))
    m = newest.join(kept, "user_id", "full").withColumn("refreshed", F.expr("_seen IS NOT NULL AND (_last_ts IS NULL OR coalesce(_n > _last_ts, false))"))
    new = profiles(events.join(m.where("refreshed").select("user_id"), "user_id", "left_semi"))
    # one join, as a union of shuffled joins breaks off where Spark compares the partitionings of its sides
    return m.join(new, "user_id", "left").select("user_id", *[F.when(F.col("refreshed"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("top", "events", "last_ts")], "refreshed")


class EventLog:
    """An append-only log: each batch is a folder of its own, named by its number, written once and never read to append.

    A batch replayed after a failure overwrites its own folder, so nothing is doubled.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, batch: DataFrame, number: int) -> None:
        batch.select(*self._empty().columns).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self._empty()
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self._empty().columns)


class KeyedTable:
    """A table cut into buckets of its keys. A merge rewrites the buckets that its batch touches; the others stay.

    Each version has a folder per rewritten bucket and a manifest that says, for every bucket, in which version it was
    written last. Readers take the highest manifest, which is moved into place whole; a version that failed before that
    is never seen and is written again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] = KEYS, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        at = self._path(f"{self.path}/manifests")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(at)), default=-1) if self._fs.exists(at) else -1

    def _manifest(self) -> dict[int, tuple[int, int]]:
        """Bucket -> (version it was written in last, version before that or -1)."""
        v = self.version()
        if v < 0:
            return {}
        return {int(b): (int(n), int(p)) for b, n, p in (r.value.split() for r in self.spark.read.text(f"{self.path}/manifests/{v}").collect())}

    def _read(self, where: dict[int, tuple[int, int]]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v{n}/bucket={b}" for b, (n, _) in sorted(where.items())])

    def read(self) -> DataFrame:
        return self._read(self._manifest())

    def update(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """change(rows of the touched buckets, batch) gives the new rows of those buckets; the new version."""
        old, v = self._manifest(), self.version() + 1
        touched = sorted(r.b for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        new = change(self._read({b: n for b, n in old.items() if b in touched}), batch)
        new.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{v}")
        there = {b for b in touched if self._fs.exists(self._path(f"{self.path}/v{v}/bucket={b}"))}
        now = {b: x for b, x in old.items() if b not in touched} | {b: (v, old[b][0] if b in old else -1) for b in there}
        draft, place = self._path(f"{self.path}/draft-{v}"), self._path(f"{self.path}/manifests/{v}")
        out = self._fs.create(draft, True)
        out.write(bytearray("\n".join(f"{b} {n} {p}" for b, (n, p) in sorted(now.items())).encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(draft, place):
            raise RuntimeError(f"{self.path} has been changed by another writer")
        for b in touched:  # readers of the version before may still be at work; what that had replaced goes
            if b in old and old[b][1] >= 0:
                self._fs.delete(self._path(f"{self.path}/v{old[b][1]}/bucket={b}"), True)
        return v


def upsert_stream(source: DataFrame, target: KeyedTable, checkpoint: str, keys: list[str] = KEYS, order: list[str] = ORDER) -> StreamingQuery:
    """Merges each micro-batch into the table; a batch replayed after a failure gives the same state."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            target.update(batch, lambda state, b: merge(state, b, keys, order))

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_stream(source: DataFrame, log: EventLog, target: KeyedTable, checkpoint: str, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Appends each micro-batch to the log and refreshes the profiles of its users; if that fails, the old profiles stay.

    Rows delivered again under an event_id count once, however far apart.
    """

    def apply(batch: DataFrame, number: int) -> None:
        log.append(batch, number)
        try:
            users = batch.select("user_id").distinct()

            def change(old: DataFrame, _: DataFrame) -> DataFrame:
                own = log.read().join(users, "user_id", "left_semi").dropDuplicates(["event_id"])
                return refresh(old.join(users, "user_id", "left_semi"), own).drop("refreshed").unionByName(old.join(users, "user_id", "left_anti"))

            if not users.isEmpty():
                target.update(users, change)
        except Exception as x:  # noqa: BLE001
            if on_error is None:
                raise
            on_error(x)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Extensions beyond the surveyed behaviour: windows with watermarks over the event stream.


def windowed_counts(source: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Tumbling or sliding counts per event type; rows later than the watermark are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return source.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(source: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return source.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
