"""Ordered operators: tiles, offsets, contiguity, first-wins, stable re-ranking, and folds that carry state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(df: DataFrame, keys: list[str], order: list[str], size: str, name: str = "offset") -> DataFrame:
    """Adds the sum of the sizes before each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def tile_ends(df: DataFrame, keys: list[str], start: str, last: Column, name: str = "end") -> DataFrame:
    """Adds where each tile ends: one before the next start; the last one at `last`."""
    return df.withColumn(name, F.coalesce(F.lead(start).over(W.partitionBy(*keys).orderBy(start)) - 1, last))


def tile_breaks(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Tiles that do not begin right after the one before."""
    before = F.lag(end).over(W.partitionBy(*keys).orderBy(start))
    return df.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col(start) != F.col("_b") + 1)).drop("_b")


def first_break(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, n, first_break): the first position at which the sorted numbers are not 1, 2, 3...; null where they are.

    Equal numbers are counted before the sort, so a group is as long as its different numbers.
    """
    c = df.groupBy(*keys, number).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("_p", before + 1)
    at = F.when(~F.col(number).eqNullSafe(F.col("_p")), F.col("_p")).when(F.col("_k") > 1, F.col("_p") + 1)
    return c.withColumn("_a", at).groupBy(*keys).agg(F.sum("_k").alias("n"), F.min("_a").alias("first_break"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; aggregated before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: the state after upserts."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank", salts: int = 32) -> DataFrame:
    """The first n rows of each key, numbered. Each key is cut down in `salts` parts first, so a hot one is no single sort."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    local = df.withColumn("_s", part).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_r") <= n).drop("_s", "_r")
    return local.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Adds the row number of each row within its key. bucket must rise with the order.

    Rows are sorted per key and bucket only; the rows in the buckets before are counts, summed over the short list of
    a key's buckets and joined back.
    """
    v = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    n = df.withColumn("_b", bucket).groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    n = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_nb"), "_o")
    same = F.col("_b").eqNullSafe(F.col("_nb"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return v.join(n, same).select(*[c for c in df.columns if c != name], (F.col("_r") + F.col("_o")).alias(name))


def stable_boost(df: DataFrame, keys: list[str], boosted: Column, rank: str, name: str = "new_rank", size: int = 100_000) -> DataFrame:
    """Adds a rank with boosted rows first and the given rank otherwise; nothing is dropped. Ranks are sorted in buckets of `size`."""
    second = F.when(boosted, 0).otherwise(1)
    return ranked(df, keys, [second, F.col(rank)], F.struct(second.alias("s"), F.floor(F.col(rank) / size).alias("r")), name)


def carry(df: DataFrame, keys: list[str], order: list[str], bucket: Column, marked: Column, name: str, forward: bool = True) -> DataFrame:
    """Adds the nearest marked (non-null) value: at or before the row (forward), or strictly after it.

    bucket must rise with the order. Rows are sorted per key and bucket only; what a bucket passes on to the next ones
    is one value, carried over the short list of a key's buckets and joined back. So a hot key is many small sorts.
    """
    v = df.withColumn("_b", bucket).withColumn("_m", marked)
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    if forward:
        local = F.last("_m", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        edge, across = F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct(*order))), (W.unboundedPreceding, -1)
        passed = F.last("_e", ignorenulls=True)
    else:
        local = F.first("_m", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
        edge, across = F.min_by("_m", F.when(F.col("_m").isNotNull(), F.struct(*order))), (1, W.unboundedFollowing)
        passed = F.first("_e", ignorenulls=True)
    edges = v.groupBy(*keys, "_b").agg(edge.alias("_e"))
    edges = edges.withColumn("_p", passed.over(W.partitionBy(*keys).orderBy("_b").rowsBetween(*across))).where(F.col("_p").isNotNull())
    edges = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_eb"), "_p")
    same = F.col("_b").eqNullSafe(F.col("_eb"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = v.withColumn("_l", local).join(edges, same, "left")
    return out.select(*[c for c in df.columns if c != name], F.coalesce("_l", "_p").alias(name))


def pack_pieces(pieces: Column, limit: int) -> Column:
    """Greedy packing of ordered pieces, joined by one space, into parts of at most `limit` bytes; null if a piece exceeds it."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        joined = F.when(acc.cur.isNull(), p).otherwise(F.concat(acc.cur, F.lit(" "), p))
        fits = F.octet_length(joined) <= limit
        return F.struct(F.when(fits, acc.done).otherwise(F.concat(acc.done, F.array(acc.cur))).alias("done"), F.when(fits, joined).otherwise(p).alias("cur"))

    packed = F.aggregate(pieces, empty, add, lambda a: F.when(a.cur.isNull(), a.done).otherwise(F.concat(a.done, F.array(a.cur))))
    return F.when(~F.exists(pieces, lambda p: F.octet_length(p) > limit), packed)


def pieces_at(text: Column, end: str) -> Column:
    """Words of a text joined up to those that match `end`: the pieces joined by spaces give the text."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, w: Column) -> Column:
        joined = F.when(acc.cur.isNull(), w).otherwise(F.concat(acc.cur, F.lit(" "), w))
        ends = w.rlike(end)
        return F.struct(F.when(ends, F.concat(acc.done, F.array(joined))).otherwise(acc.done).alias("done"), F.when(~ends, joined).alias("cur"))

    return F.aggregate(F.split(text, " "), empty, add, lambda a: F.when(a.cur.isNull(), a.done).otherwise(F.concat(a.done, F.array(a.cur))))


def pack_bytes(text: Column, limit: int) -> Column:
    """struct<level, parts>: parts of at most `limit` bytes at the coarsest level that fits: sentence, clause, word.

    White space is flattened first; joined by spaces the parts give the flattened text. Level `none` and null parts
    where one word exceeds the limit.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    s = pack_pieces(pieces_at(flat, "[.!?…][\"”’)]?$"), limit)
    c = pack_pieces(pieces_at(flat, "[,;:—–][\"”’)]?$"), limit)
    w = pack_pieces(F.split(flat, " "), limit)
    level = F.when(s.isNotNull(), "sentence").when(c.isNotNull(), "clause").when(w.isNotNull(), "word").otherwise("none")
    return F.struct(level.alias("level"), F.coalesce(s, c, w).alias("parts"))


def budget_select(items: Column, size: str, max_items: int, max_size: int, max_total: int) -> Column:
    """Status of each of an array of structs, in order: taken, too-long, over-max or over-budget; later smaller ones may still fit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = x[size]
        status = F.when(s > max_size, "too-long").when(acc.n >= max_items, "over-max").when(acc.used + s > max_total, "over-budget").otherwise("taken")
        taken = status == "taken"
        return F.struct((acc.n + F.when(taken, 1).otherwise(0)).alias("n"), (acc.used + F.when(taken, s).otherwise(0)).cast("bigint").alias("used"), F.concat(acc.out, F.array(status)).alias("out"))

    return F.aggregate(items, zero, add, lambda a: a.out)


def batch_numbers(sizes: Column, target: int) -> Column:
    """Batch of each of an array of sizes, in order; a new one begins before the target would be passed, and none is split."""
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        new = (acc.n > 0) & (acc.n + s > target)
        b = acc.b + F.when(new, 1).otherwise(0)
        return F.struct(b.alias("b"), (F.when(new, 0).otherwise(acc.n) + s).cast("bigint").alias("n"), F.concat(acc.out, F.array(b)).alias("out"))

    return F.aggregate(sizes, zero, add, lambda a: a.out)


def diversify(ranked: Column, limit: int) -> Column:
    """Greedy diversification of array<struct<id, themes>> in rank order: admit a row if it has an unclaimed theme, claim exactly one, stop at the limit.

    The result is an array of (id, claimed theme).
    """
    zero = F.struct(F.array().cast("array<string>").alias("claimed"), F.array().cast("array<struct<id:bigint,theme:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        free = F.filter(x.themes, lambda t: ~F.array_contains(acc.claimed, t))
        take = (F.size(acc.out) < limit) & (F.size(free) > 0)
        theme = F.get(free, F.lit(0))
        return F.struct(F.when(take, F.concat(acc.claimed, F.array(theme))).otherwise(acc.claimed).alias("claimed"), F.when(take, F.concat(acc.out, F.array(F.struct(x.id.alias("id"), theme.alias("theme"))))).otherwise(acc.out).alias("out"))

    return F.aggregate(ranked, zero, add, lambda a: a.out)
