"""Sinks: deterministic artifacts, manifests, shards, journals, reports."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.operators.aggregates import set_digest
from lontar.sources.readers import SourceError
from lontar.util import scalar, ship


def artifact(name: str, df: DataFrame) -> DataFrame:
    """(name, sha256, bytes, rows): digest of a table, whatever its row order and partitions; keys in column order, nulls included."""
    j = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    size = F.lit(scalar(j.agg(F.coalesce(F.sum(F.octet_length("j")), F.lit(0)))))
    digest = set_digest(j.withColumn("one", F.lit(1)), ["one"], F.col("j")).agg(F.max("digest").alias("digest"), F.max("n").alias("n"))
    return digest.select(F.lit(name).alias("name"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("sha256"), size.alias("bytes"), F.coalesce("n", F.lit(0)).alias("rows"))


def manifest(artifacts: DataFrame) -> DataFrame:
    """(version, artifacts): the version is the first 12 hex digits of the digest of the sorted name:hash lines."""
    line = F.concat_ws(":", "name", "sha256")
    return artifacts.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256), 1, 12).alias("version"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("sha256", "bytes", "rows"))))).alias("artifacts"))


def write_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines; gzip at the best level."""
    df.write.mode("overwrite").options(**({"compression": compression, "zlib.compress.level": "BEST_COMPRESSION"} if compression else {})).json(path)


def write_shards(df: DataFrame, path: str, keys: list[str], expected: int | None = None) -> int:
    """One folder per key; refuses to write fewer shards than expected. The number of shards."""
    n = df.select(*keys).distinct().count()
    if expected is not None and n < expected:
        raise SourceError(f"{n} shards of {expected}: not written")
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)
    return n


def shard_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bytes, gz_bytes): each shard's JSON lines as they are and as gzip of level 9. Lines are compressed per task
    and shard, one stream each, so no shard is held whole; parts of a shard in several tasks add up."""
    lines = df.select(*keys, F.to_json(F.struct(*df.columns)).alias("_j"))

    def run(frames):
        import pandas as pd

        open_: dict = {}
        for f in frames:
            for key, part in f.groupby(keys, dropna=False, sort=False):
                z = open_.setdefault(key, [zlib.compressobj(9, zlib.DEFLATED, 31), 0, 0])
                data = ("\n".join(part["_j"]) + "\n").encode()
                z[1] += len(data)
                z[2] += len(z[0].compress(data))
        rows = [(*(None if pd.isna(k) else k for k in key), n, m + len(z.flush())) for key, (z, n, m) in open_.items()]
        yield pd.DataFrame(rows, columns=[*keys, "bytes", "gz_bytes"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = lines.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{fields}, bytes bigint, gz_bytes bigint")
    return parts.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("gz_bytes").alias("gz_bytes"))


def over_budget(df: DataFrame, keys: list[str], budget: int, gz: bool = True) -> DataFrame:
    """(keys, bytes, gz_bytes): shards whose JSON exceeds a budget, compressed or as it is."""
    return shard_sizes(df, keys).where(F.col("gz_bytes" if gz else "bytes") > budget)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the journal lacks; a job that stopped resumes where it was. The number appended."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    todo = df.dropDuplicates(keys)
    if there:
        todo = todo.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def vector_rows(df: DataFrame, key: Column, values: str, meta: list[str]) -> DataFrame:
    """(id, values, metadata) rows for an index."""
    return df.select(key.alias("id"), F.col(values).alias("values"), F.struct(*meta).alias("metadata"))


def markdown_table(df: DataFrame) -> str:
    """A table as Markdown, every row, in its own order. A report is read by people: give a table of that size."""
    rows = df.toLocalIterator()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


ship(__name__)
