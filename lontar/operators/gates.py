"""Data-quality gates: each yields its violations as (gate, detail), and all are reported together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "gate string, detail string"


class IntegrityError(Exception):
    """Raised by require() with every violation in its message."""


def rows(name: str, df: DataFrame, bad: Column, detail: Column) -> DataFrame:
    """Rows that meet a condition (null counts as not meeting it)."""
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(name).alias("gate"), detail.cast("string").alias("detail"))


def orphans(name: str, child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the child that the parent lacks, with how many rows have them."""
    lost = child.groupBy(*keys).agg(F.count("*").alias("_n")).join(parent.select(*keys).distinct(), keys, "left_anti")
    return lost.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.concat_ws(":", *keys), F.concat(F.lit("x"), "_n")).alias("detail"))


def unique(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return g.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.concat_ws(":", *keys), F.concat(F.lit("x"), "_n")).alias("detail"))


def exactly(name: str, df: DataFrame, keys: list[str], condition: Column, n: int) -> DataFrame:
    """Groups in which the condition does not hold for exactly n rows."""
    g = df.groupBy(*keys).agg(F.count_if(condition).alias("_n")).where(F.col("_n") != n)
    return g.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.concat_ws(":", *keys), F.col("_n").cast("string")).alias("detail"))


def at_least(name: str, df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Groups with fewer than n different values."""
    g = df.groupBy(*keys).agg(F.countDistinct(value).alias("_n")).where(F.col("_n") < n)
    return g.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.concat_ws(":", *keys), F.col("_n").cast("string")).alias("detail"))


def contiguous(name: str, df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Groups whose distinct numbers are not 1, 2, 3...: by their count, least and greatest."""
    g = df.groupBy(*keys).agg(F.countDistinct(number).alias("_n"), F.min(number).alias("_a"), F.max(number).alias("_b")).where("_a <> 1 OR _b <> _n")
    return g.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.concat_ws(":", *keys), F.concat_ws("..", "_a", "_b"), F.concat(F.lit("n"), "_n")).alias("detail"))


def permutation(name: str, df: DataFrame, number: str) -> DataFrame:
    """Numbers that are missing or repeated in a permutation of 1..n."""
    g = df.groupBy(number).agg(F.count("*").alias("_k"))
    bad = g.where((F.col("_k") > 1) | ~F.col(number).between(1, df.count()))
    return bad.select(F.lit(name).alias("gate"), F.concat_ws(" ", F.col(number).cast("string"), F.concat(F.lit("x"), "_k")).alias("detail"))


def constants(name: str, actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Differences of a one-row table of counts from audited values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("bigint").alias("v"), F.col(k).cast("bigint").alias("a")) for k, v in expected.items()]))
    return actual.select(pairs.alias("x")).where("NOT (x.v <=> x.a)").select(F.lit(name).alias("gate"), F.concat_ws(" ", "x.k", F.col("x.a").cast("string"), F.concat(F.lit("not "), F.col("x.v").cast("string"))).alias("detail"))


def run_all(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def require(violations: DataFrame) -> None:
    """Raises IntegrityError if there are violations; the message counts them per gate and names every one."""
    counts = {r.gate: r["count"] for r in violations.groupBy("gate").count().collect()}
    if counts:
        named = [f"{r.gate}: {r.detail}" for r in violations.orderBy("gate", "detail").toLocalIterator()]
        raise IntegrityError(f"{counts}\n" + "\n".join(named))
