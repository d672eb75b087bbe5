"""References to records that do not exist, or do not exist at the time of the reference.

Parent and child keys are united in one long table with a tag, grouped by parent table and key, and the groups without
a parent flag are the orphans. Time enters the key as the segment between two changes of the parents in which it lies,
so a reference to a record that has ended or has not begun falls into another group than the record itself. Children
are counted per key and period before the shuffle; a hot key is a handful of counters, never a group of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.util import cut, need

#: Up to so many different moments of change the segments are computed against a literal array; beyond, by a join with each key's own moments.
MAX_MOMENTS = 512


def _segment(at: Column, moments: Column) -> Column:
    return F.when(at.isNull(), -1).otherwise(F.size(F.filter(moments, lambda m: m <= at)))


def with_segments(children: DataFrame, parents: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """children + seg, and parents as (keys, seg): the segments in which each is in force.

    parents has keys, valid_from (null: always) and valid_to (null: still). A child without a time has segment -1,
    which no parent covers.
    """
    moments = parents.select(F.explode(F.array("valid_from", "valid_to")).alias("m")).where("m IS NOT NULL").distinct()
    known = [r.m for r in moments.limit(MAX_MOMENTS + 1).collect()]
    if len(known) <= MAX_MOMENTS:
        m = F.array(*[F.lit(x).cast(parents.schema["valid_from"].dataType) for x in sorted(known)]) if known else F.array().cast(f"array<{parents.schema['valid_from'].dataType.simpleString()}>")
        held = parents.withColumn("_m", m)
        children = children.withColumn("_m", m)
    else:
        per = parents.select(*keys, F.explode(F.array("valid_from", "valid_to")).alias("m")).groupBy(*keys).agg(F.sort_array(F.collect_set("m")).alias("_m"))
        held = parents.join(per, keys)
        children = children.join(per, keys, "left")
    children = children.withColumn("seg", F.when(F.col("_m").isNull(), 0).otherwise(_segment(F.col(at), F.col("_m")))).drop("_m")
    first = F.when(F.col("valid_from").isNull(), 0).otherwise(_segment(F.col("valid_from"), F.col("_m")))
    last = F.when(F.col("valid_to").isNull(), F.size("_m")).otherwise(_segment(F.col("valid_to"), F.col("_m")) - 1)
    held = held.withColumn("_a", first).withColumn("_b", last).where("_b >= _a").select(*keys, F.explode(F.sequence("_a", "_b")).alias("seg"))
    return children, held


def orphan_keys(children: DataFrame, parents: DataFrame, keys: list[str], period: str, parent_table: str) -> DataFrame:
    """(parent_table, *keys, seg, periods): the groups that lack a parent, with their references per period.

    children has keys, seg and period; parents has keys and seg.
    """
    c = children.groupBy(*keys, "seg", period).agg(F.count("*").alias("n")).withColumn("is_parent", F.lit(0))
    p = parents.distinct().withColumn("is_parent", F.lit(1)).withColumn("n", F.lit(0).cast("bigint")).withColumn(period, F.lit(None).cast(children.schema[period].dataType))
    long = c.unionByName(p).withColumn("parent_table", F.lit(parent_table))
    return (
        long.groupBy("parent_table", *keys, "seg")
        .agg(F.max("is_parent").alias("has_parent"), F.collect_list(F.when(F.col("is_parent") == 0, F.struct(F.col(period).alias("period"), "n"))).alias("periods"))
        .where("has_parent = 0")
        .drop("has_parent")
    )


def surah_parents(meta: DataFrame) -> DataFrame:
    """surah_meta as (surah, ayah, valid_from, valid_to), one row per declared ayah."""
    m = need(meta, ["n", "ayahs", "added_at", "removed_at"]).where("n IS NOT NULL AND ayahs >= 1 AND added_at IS NOT NULL")
    return m.select(F.col("n").alias("surah"), F.explode(F.sequence(F.lit(1), F.col("ayahs"))).alias("ayah"), F.col("added_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))


def _prepared(refs: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = refs.where("surah IS NOT NULL AND ayah IS NOT NULL").withColumn("period", F.date_format("published_at", "yyyy-MM"))
    return with_segments(c, surah_parents(meta), ["surah", "ayah"], "published_at")


def orphan_references(refs: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows of refs (any columns, with surah, ayah and published_at) that point at no ayah in force.

    A reference without surah or ayah is none. With a null published_at nothing is in force, so it is an orphan.
    A meta row without n, ayahs or added_at is never in force. The order and repetition of meta rows do not matter.
    """
    c, p = _prepared(refs, meta)
    c = cut(c)  # read for the keys and for the rows
    lost = orphan_keys(c, p, ["surah", "ayah"], "period", "surah_meta").select("surah", "ayah", "seg")
    return c.join(lost, ["surah", "ayah", "seg"], "left_semi").select(*refs.columns)


def orphan_counts(refs: DataFrame, meta: DataFrame, child_table: str = "peta_shards") -> DataFrame:
    """(child_table, parent_table, period, orphans, orphan_keys): counts of orphan references per month of published_at."""
    c, p = _prepared(refs, meta)
    lost = orphan_keys(c, p, ["surah", "ayah"], "period", "surah_meta")
    return (
        lost.select("parent_table", "surah", "ayah", F.explode("periods").alias("x"))
        .groupBy("parent_table", F.col("x.period").alias("period"))
        .agg(F.sum("x.n").alias("orphans"), F.countDistinct("surah", "ayah").alias("orphan_keys"))
        .select(F.lit(child_table).alias("child_table"), "parent_table", "period", "orphans", "orphan_keys")
    )
