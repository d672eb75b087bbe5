"""Items that appear together: pair counts and association over baskets.

Large-basket blocking: a basket of at most `block` items yields its pairs in place. A larger one is split into chunks
of `block` items; the pairs of its chunks (i <= j) are jobs of two short arrays, equal ones counted once and multiplied,
and each yields one chunk product, so no row holds more than block * block pairs, and every pair is still counted. The
counts of large and ordinary baskets are summed before the shuffle.

Null items and null baskets count as empty; an item repeated in a basket counts once; a basket without items still
counts in N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.operators import pairs
from lontar.operators.nested import shard_trees
from lontar.operators.pairs import BLOCK
from lontar.util import cut


def pair_counts(baskets: DataFrame, items: str = "items", block: int = BLOCK) -> DataFrame:
    """(a, b, n_ab): in how many baskets both items occur; a < b by code points."""
    return pairs.pair_counts(baskets, items, block).withColumnRenamed("n", "n_ab")


def associations(baskets: DataFrame, items: str = "items", block: int = BLOCK) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift): every pair that occurs, with its ratio to chance n_ab * N / (n_a * n_b)."""
    total = baskets.count()
    single = baskets.select(F.explode(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("item")).groupBy("item").agg(F.count("*").alias("n_item"))
    p = pair_counts(baskets, items, block)
    p = p.join(single.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a").join(single.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    return p.select("a", "b", "n_ab", "n_a", "n_b", F.lit(total).cast("bigint").alias("n"), (F.col("n_ab") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))


def reference_baskets(shards: DataFrame) -> DataFrame:
    """(items): one basket of category slugs per reference of every shard that parses."""
    t = shard_trees(shards, ("slug",)).select("slug", F.explode("tree").alias("s"))
    t = t.select("slug", F.explode("s.entries").alias("e")).select("slug", F.explode("e.refs").alias("r"))
    return cut(t.select(F.array_sort(F.array_distinct(F.concat(F.array("slug"), F.coalesce("r.bridge", F.array().cast("array<string>"))))).alias("items")))


def frequent(assoc: DataFrame, least: int = 5, ratio: int = 4) -> DataFrame:
    """Pairs in at least `least` baskets and at least `ratio` times as often as chance, by whole numbers."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return assoc.where((F.col("n_ab") >= least) & (big("n_ab") * big("n") >= big("n_a") * big("n_b") * ratio))


def against_published(assoc: DataFrame, bonds: DataFrame) -> DataFrame:
    """Every published pair (in either order, latest release first) beside its present count and lift."""
    b = bonds.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    b = b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n").alias("n_published"), "release")
    b = b.groupBy("a", "b").agg(F.max_by("n_published", F.struct("release", "n_published")).alias("n_published"))
    return b.join(assoc, ["a", "b"], "left").select("a", "b", "n_published", F.coalesce("n_ab", F.lit(0)).alias("n_ab"), F.round("lift", 6).alias("lift"))
