"""Counts of item pairs in sets, with large sets cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def pairs_within(items: Column) -> Column:
    """Pairs (a < b) of a sorted array of distinct items."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def pairs_across(left: Column, right: Column) -> Column:
    """Pairs of an item of either array, the smaller first; the arrays have no item in common."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def pair_counts(sets: DataFrame, items: str = "items", block: int = BLOCK) -> DataFrame:
    """(a, b, n): in how many sets both items occur; a < b by code points. Null items and repeated ones do not count.

    A set of at most `block` items yields its pairs in place. A larger one is split into chunks of `block` items; every
    pair of its chunks is a job of two short arrays, and no row holds more than one job's pairs. Equal jobs of equal
    sets are counted first and done once, so a large set that comes again and again is no hot key.
    """
    s = sets.select(F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("s"))
    small = s.where(F.size("s").between(2, block)).select(F.explode(pairs_within(F.col("s"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    big = s.where(F.size("s") > block).select("s", F.expr(f"(size(s) - 1) div {block}").cast("int").alias("last"))
    chunk = lambda i: F.slice("s", i * block + 1, block)
    jobs = big.select("s", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select("s", "i", F.explode(F.sequence("i", "last")).alias("j"))
    jobs = jobs.select(chunk(F.col("i")).alias("l"), chunk(F.col("j")).alias("r"), (F.col("i") == F.col("j")).alias("same")).groupBy("l", "r", "same").agg(F.count("*").alias("m"))
    product = F.when(F.col("same"), pairs_within(F.col("l"))).otherwise(pairs_across(F.col("l"), F.col("r")))
    large = jobs.select(F.explode(product).alias("p"), "m").groupBy("p.a", "p.b").agg(F.sum("m").alias("n"))
    return small.unionByName(large).groupBy("a", "b").agg(F.sum("n").alias("n"))
