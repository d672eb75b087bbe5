"""Array and map functions, sort keys and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_set(items: Column, valid: list[str], cap: int = 3) -> Column:
    """Distinct members of a closed set, in order, at most cap."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isin(*valid))), 1, cap)


def invert(m: Column) -> Column:
    """Value -> sorted keys, as an array of (value, keys)."""
    values = F.array_sort(F.array_distinct(F.map_values(m)))
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.array_sort(F.map_keys(F.map_filter(m, lambda _, x: x == v))).alias("keys")))


def natural_key(c: Column) -> Column:
    """Sort key under which numbers inside a string compare by value."""
    runs = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), 20, "0")).otherwise(x)), "")


def enum_place(c: Column, order: list[str]) -> Column:
    """Place in an explicit order; what is not listed comes last."""
    p = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(p > 0, p).otherwise(len(order) + 1)


def centred(df: DataFrame, xs: list[str], radius: float) -> DataFrame:
    """Coordinates moved to their mean and scaled so that the farthest lies at the radius, rounded."""
    mean = df.agg(*[F.avg(x) for x in xs]).first()
    moved = [F.col(x) - F.lit(m) for x, m in zip(xs, mean, strict=True)]
    far = df.agg(F.max(F.sqrt(sum(x * x for x in moved)))).first()[0]
    scale = radius / far if far else 0.0
    return df.select(*[c for c in df.columns if c not in xs], *[F.round(m * F.lit(scale)).cast("bigint").alias(x) for x, m in zip(xs, moved, strict=True)])


def by_ordinal(lists: DataFrame, key: str, items: str, ordinals: DataFrame) -> DataFrame:
    """(key, ordinal, item, *others) of ordinals(key, ordinal, ...): joined back by position; unknown positions are dropped."""
    x = lists.select(key, F.posexplode(items).alias("ordinal", "item"))
    return ordinals.join(x, [key, "ordinal"])
