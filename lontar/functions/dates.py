"""Solar times of a day and place as column arithmetic, and other date functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("dawn", "sunrise", "noon", "afternoon", "sunset", "night")


def local_day(instant: Column, offset_minutes: Column) -> Column:
    """The civil day at an instant, given the offset from UTC."""
    return F.to_date(instant + F.make_dt_interval(mins=offset_minutes))


def julian_day(day: Column, hour_utc: Column) -> Column:
    """Julian day of a Gregorian date at an hour."""
    return F.datediff(day, F.lit("2000-01-01").cast("date")).cast("double") + 2451544.5 + hour_utc / 24


def _rad(c: Column) -> Column:
    return F.radians(c)


def with_steps(df: DataFrame, **steps) -> DataFrame:
    """Adds columns one after the other; each step is a function of the ones before, so nothing is computed twice."""
    for name, step in steps.items():
        df = df.withColumn(name, step(F.col))
    return df


def with_solar(df: DataFrame, day: str, offset: str) -> DataFrame:
    """Adds declination (degrees) and equation (of time, minutes) at local noon, after the standard low-precision series.

    Fixed values: the coefficients of that series.
    """
    kept = df.columns
    out = with_steps(
        df,
        _t=lambda c: (julian_day(c(day), 12 - c(offset) / 60) - 2451545) / 36525,
        _mean=lambda c: F.pmod(280.46646 + c("_t") * (36000.76983 + c("_t") * 0.0003032), F.lit(360.0)),
        _m=lambda c: _rad(357.52911 + c("_t") * (35999.05029 - 0.0001537 * c("_t"))),
        _e=lambda c: 0.016708634 - c("_t") * (0.000042037 + 0.0000001267 * c("_t")),
        _centre=lambda c: F.sin(c("_m")) * (1.914602 - c("_t") * (0.004817 + 0.000014 * c("_t"))) + F.sin(2 * c("_m")) * (0.019993 - 0.000101 * c("_t")) + F.sin(3 * c("_m")) * 0.000289,
        _node=lambda c: _rad(125.04 - 1934.136 * c("_t")),
        _apparent=lambda c: _rad(c("_mean") + c("_centre") - 0.00569 - 0.00478 * F.sin(c("_node"))),
        _tilt=lambda c: _rad(23 + (26 + (21.448 - c("_t") * (46.815 + c("_t") * (0.00059 - c("_t") * 0.001813))) / 60) / 60 + 0.00256 * F.cos(c("_node"))),
        _y=lambda c: F.pow(F.tan(c("_tilt") / 2), F.lit(2.0)),
        _l=lambda c: _rad(c("_mean")),
        declination=lambda c: F.degrees(F.asin(F.sin(c("_tilt")) * F.sin(c("_apparent")))),
        equation=lambda c: 4 * F.degrees(c("_y") * F.sin(2 * c("_l")) - 2 * c("_e") * F.sin(c("_m")) + 4 * c("_e") * c("_y") * F.sin(c("_m")) * F.cos(2 * c("_l")) - 0.5 * c("_y") * c("_y") * F.sin(4 * c("_l")) - 1.25 * c("_e") * c("_e") * F.sin(2 * c("_m"))),
    )
    return out.select(*kept, "declination", "equation")


def hour_angle(lat: Column, declination: Column, altitude: Column) -> Column:
    """Degrees from noon at which the sun stands at an altitude; null where it never does."""
    ratio = (F.sin(_rad(altitude)) - F.sin(_rad(lat)) * F.sin(_rad(declination))) / (F.cos(_rad(lat)) * F.cos(_rad(declination)))
    return F.when(ratio.between(-1, 1), F.degrees(F.acos(ratio)))


def horizon_dip(metres: Column) -> Column:
    return F.when(metres > 0, 0.0293 * F.sqrt(metres)).otherwise(F.lit(0.0))


def shadow_altitude(lat: Column, declination: Column, factor: float) -> Column:
    return F.degrees(F.atan(1 / (factor + F.tan(_rad(F.abs(lat - declination))))))


def with_day_times(df: DataFrame, day: str, lat: str, lon: str, metres: str, offset: str, dawn: float = 20.0, dusk: float = 18.0, factor: float = 1.0) -> DataFrame:
    """Adds a column for each of SLOTS: its time in local minutes of the day, null where there is none."""
    kept = df.columns
    out = with_steps(
        with_solar(df, day, offset),
        _noon=lambda c: 720 - 4 * c(lon) - c("equation") + c(offset),
        _rim=lambda c: hour_angle(c(lat), c("declination"), F.lit(-0.8333) - horizon_dip(c(metres))),
        _first=lambda c: hour_angle(c(lat), c("declination"), F.lit(-dawn)),
        _last=lambda c: hour_angle(c(lat), c("declination"), F.lit(-dusk)),
        _high=lambda c: shadow_altitude(c(lat), c("declination"), factor),
        _shadow=lambda c: hour_angle(c(lat), c("declination"), c("_high")),
    )
    n = F.col("_noon")
    slots = (n - F.col("_first") * 4, n - F.col("_rim") * 4, n, n + F.col("_shadow") * 4, n + F.col("_rim") * 4, n + F.col("_last") * 4)
    return out.select(*kept, *[m.alias(x) for x, m in zip(SLOTS, slots, strict=True)])


def next_after(minute: Column) -> Column:
    """Name of the first of SLOTS not before a minute; tomorrow's first where none is left."""
    out = F.coalesce(*[F.when(F.col(x).isNotNull(), x) for x in SLOTS])
    for x in reversed(SLOTS):
        out = F.when(F.col(x) >= minute, x).otherwise(out)
    return out


def daily_pick(day: Column, n: int) -> Column:
    """The same number from 0 to n - 1 for everyone on a day."""
    return F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(n))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
