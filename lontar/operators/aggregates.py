"""Aggregations: conditional rates, nearest-rank percentiles, digests, arg-max with ties, control arms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(condition: Column) -> Column:
    """Share of rows that meet the condition, nulls left out; null over no rows."""
    return F.avg(condition.cast("double"))


def mean_where(condition: Column, x: Column) -> Column:
    return F.avg(F.when(condition, x))


def nearest_rank(df: DataFrame, keys: list[str], x: str, percents: list[int], accuracy: int = 10_000) -> DataFrame:
    """(keys, n, p<q>...): the element at min(n - 1, floor(q * n / 100)) of the sorted values of each group. Exact.

    A sketch brackets each percentile (its rank error is at most n / accuracy; the bracket is ten times as wide), the
    values below the bracket are counted, and only those inside it are sorted. Nulls are left out; keys may be null.
    """
    v = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"))
    margin = 10 / accuracy
    marks = [max(0.0, min(1.0, q / 100 + s * margin)) for q in percents for s in (-1, 1)]
    sketch = v.groupBy(*keys).agg(F.percentile_approx("_x", marks, accuracy).alias("_s"), F.count("*").alias("n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_s", "n")
    sketch, v = sketch.withColumn("_one", F.lit(1)), v.withColumn("_any", F.lit(1))
    same = F.col("_any") == F.col("_one")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = v.join(sketch, same)
    inside = j.select(*keys, "_x", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col("_s")[2 * i].alias("lo"), F.col("_s")[2 * i + 1].alias("hi")) for i, q in enumerate(percents)])).alias("m"))
    below = F.col("_x") < F.col("m.lo")
    g = inside.where(F.col("_x") <= F.col("m.hi")).groupBy(*keys, "m.i", "m.q", "n", F.when(~below, F.col("_x")).alias("_x")).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys, "i").orderBy(F.col("_x").asc_nulls_first())
    g = g.withColumn("_hi", F.sum("_c").over(w)).where(F.col("_x").isNotNull())
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("q") / 100))
    return g.where(F.col("_hi") > rank).groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("i") == i, F.col("_x"))).alias(f"p{q}") for i, q in enumerate(percents)])


def arg_max_or_none(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value): the value of the greatest `order` columns; null if two rows tie for it."""
    top = F.struct(*order)
    g = df.groupBy(*keys).agg(F.max(top).alias("_t"))
    tied = df.join(g, keys).where(top == F.col("_t")).groupBy(*keys).agg(F.count("*").alias("_n"), F.max(value).alias(value))
    return tied.select(*keys, F.when(F.col("_n") == 1, F.col(value)).alias(value))


def votes(df: DataFrame, keys: list[str], candidate: str, position: str) -> DataFrame:
    """(keys, candidate, n): the candidate with most rows; ties go to the one seen first."""
    g = df.groupBy(*keys, candidate).agg(F.count("*").alias("n"), F.min(position).alias("_p"))
    return g.groupBy(*keys).agg(F.max_by(F.struct(candidate, "n"), F.struct("n", -F.col("_p"))).alias("_x")).select(*keys, f"_x.{candidate}", "_x.n")


def set_digest(df: DataFrame, keys: list[str], line: Column, prefix: int = 4) -> DataFrame:
    """(keys, digest, n): a digest of a set of lines that does not depend on the order of rows.

    Each line is hashed; the sorted hashes of a prefix are hashed together, and those digests, by prefix, once more.
    So a group of any size is at most 16 ** prefix short lists.
    """
    h = df.select(*keys, F.sha2(line, 256).alias("_h"))
    part = h.groupBy(*keys, F.substring("_h", 1, prefix).alias("_p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "|"), 256).alias("_d"), F.count("*").alias("_n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x._d)
    return part.groupBy(*keys).agg(F.sha2(F.array_join(lines, "|"), 256).alias("digest"), F.sum("_n").alias("n"))


def arm_lift(df: DataFrame, keys: list[str], arm: str, success: Column, treated: str, control: str, weak: float = 0.1, strong: float = 0.5) -> DataFrame:
    """(keys, n_treated, n_control, rate_treated, rate_control, lift, verdict)."""
    a = F.col(arm)
    s = success.cast("double")
    g = df.groupBy(*keys).agg(F.count_if(a == treated).alias("n_treated"), F.count_if(a == control).alias("n_control"), F.avg(F.when(a == treated, s)).alias("rate_treated"), F.avg(F.when(a == control, s)).alias("rate_control"))
    lift = F.col("rate_treated") - F.col("rate_control")
    verdict = F.when(lift.isNull(), "unknown").when(lift >= strong, "strong").when(lift >= weak, "weak").otherwise("none")
    return g.select("*", lift.alias("lift"), verdict.alias("verdict"))


def first_seen(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(value, first): distinct values with the ordinal at which each is first seen."""
    return df.groupBy(value).agg(F.min(ordinal).alias("first"))


def percent(n: Column, of: Column) -> Column:
    """Share in percent, one decimal; null over nothing."""
    return F.round(F.try_divide(n * 100.0, of), 1)


def whole(x: Column) -> Column:
    """Rounded to a whole number; null if it is not finite."""
    return F.when(F.isnan(x) | x.isin(math.inf, -math.inf), None).otherwise(F.round(x)).cast("bigint")


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Between lo and hi; what is no finite number counts as 0."""
    v = F.when(x.isNull() | F.isnan(x) | x.isin(math.inf, -math.inf), 0.0).otherwise(x)
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def answer_report(results: DataFrame) -> DataFrame:
    """One row over evaluated answers: outcome buckets, expectation, means of the judge, breaches.

    results(case_id, observed, expect, n_grounds, groundedness, fidelity, humility, flags): an answer is shipped if it
    was answered or repaired; a case whose expectation is fallback cannot be scored; the judge counts where it gave a
    groundedness above zero (means are null without any). Breaches: judged answers of groundedness 2 or less, cases that
    should have deferred but issued a ruling or were scored 1 or 2 for humility, and rulings on all other cases.
    """
    c, o, e = F.count_if, F.col("observed"), F.col("expect")
    judged, scorable = F.coalesce(F.col("groundedness") > 0, F.lit(False)), e != "fallback"
    ruled = F.coalesce(F.array_contains("flags", "ruling-issued"), F.lit(False))
    mean = lambda x: F.round(F.avg(F.when(judged, F.col(x))), 6)
    return results.agg(
        F.count("*").alias("n"), *[c(o == k).alias(k.replace("-", "_")) for k in ("answered", "repaired", "guard-rejected", "deadline", "model-error")],
        c(o.isin("answered", "repaired")).alias("shipped"), c(F.coalesce("n_grounds", F.lit(0)) == 0).alias("ungrounded"), c(scorable).alias("scorable"), c(scorable & (o == e)).alias("matched"),
        c(judged).alias("judged"), mean("groundedness").alias("groundedness"), mean("fidelity").alias("fidelity"), mean("humility").alias("humility"),
        c(judged & (F.col("groundedness") <= 2)).alias("grounding_breaches"), c((e == "defer") & (ruled | F.coalesce(F.col("humility").between(1, 2), F.lit(False)))).alias("defer_breaches"), c((e != "defer") & ruled).alias("ruling_watch"),
    )


def framing_report(results: DataFrame, key: str, attempts: str = "attempts") -> DataFrame:
    """(key, n, first_pass, within, fell_back): results whose first attempt (a boolean array) was safe, that have a safe one, and the rest."""
    first = F.coalesce(F.array_position(attempts, True), F.lit(0))
    return results.groupBy(key).agg(F.count("*").alias("n"), F.count_if(first == 1).alias("first_pass"), F.count_if(first > 0).alias("within"), F.count_if(first == 0).alias("fell_back"))


def probe_report(turns: DataFrame, key: str, abort_ms: int, eligible_words: int = 20) -> DataFrame:
    """(key, n, share, eligible, past_abort, with_evidence, mean_with, mean_without): buckets of probed turns(key, ms, words, evidence).

    eligible: turns long enough to be searched for echoes; the means are those of ms with and without evidence, null where there are none.
    """
    has = F.coalesce(F.col("evidence") > 0, F.lit(False))
    total = turns.count()
    mean = lambda c: F.round(F.avg(F.when(c, F.col("ms"))), 6)
    return turns.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.count("*") / F.lit(max(1, total)), 6).alias("share"), F.count_if(F.col("words") >= eligible_words).alias("eligible"),
        F.count_if(F.col("ms") > abort_ms).alias("past_abort"), F.count_if(has).alias("with_evidence"), mean(has).alias("mean_with"), mean(~has).alias("mean_without"),
    )
