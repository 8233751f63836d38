"""Numeric, null and calendar semantics used by all operators.

Conventions: SQL NULL is the only missing value (NaN is mapped to it on read),
a percentage of an empty set is 0, standard deviations are sample ones, skew is
the bias-corrected one and an empty calendar period sums to 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

GRAINS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
STEP = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TIME_TYPES)]


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col(f"`{name.replace('`', '``')}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN and infinities to NULL and zone-less timestamps to TIMESTAMP, in one projection."""
    out = []
    for field in df.schema:
        c = col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            bad = F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
            out.append(F.when(~bad, c).alias(field.name))
        elif isinstance(field.dataType, T.TimestampNTZType):
            out.append(c.cast("timestamp").alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    out = part.cast("double") * F.lit(100.0) / F.greatest(whole.cast("double"), F.lit(1.0))
    return out if digits is None else F.round(out, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth(current: Column, previous: Column, digits: int | None = 2) -> Column:
    """Change against |previous| in percent, NULL when previous is 0 or missing."""
    out = ratio(current - previous, F.abs(previous)) * F.lit(100.0)
    return out if digits is None else F.round(out, digits)


def direction(change: Column, up: str = "up", down: str = "down", flat: str = "flat") -> Column:
    return F.when(change > 0, up).when(change < 0, down).otherwise(flat)


def skew_corrected(c: Column) -> Column:
    """Bias-corrected skewness; NULL for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def period_start(time: Column, grain: str) -> Column:
    return F.date_trunc(GRAINS[grain], time)


def period_label(start: Column, grain: str) -> Column:
    """The last day of the period that begins at ``start``, as a date."""
    day = start.cast("date")
    if grain == "D":
        return day
    if grain == "W":
        return F.date_add(day, 6)
    months = {"M": 1, "Q": 3, "Y": 12}[grain]
    return F.date_sub(F.add_months(day, months), 1)


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 as double (fractions dropped)."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(1000000)).cast("double")


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """``df``, or its first ``limit`` rows where the caller asks for a limit."""
    return df if limit is None else df.limit(limit)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 60, "Medium").otherwise("Low")


def confidence_percent(scores: Column) -> Column:
    """Mean of an array of scores on a 0..1 or 0..100 scale, as 0..100, halves to the even number; 50 when empty."""
    unit = F.transform(
        F.filter(scores, lambda s: s.isNotNull()),
        lambda s: clamp(F.when(s > 1, s / F.lit(100.0)).otherwise(s), 0.0, 1.0),
    )
    n = F.size(unit)
    total = F.aggregate(unit, F.lit(0.0), lambda a, s: a + s)
    return F.when(n > 0, F.rint(total / F.greatest(n, F.lit(1)) * 100)).otherwise(F.lit(50.0)).cast("long")
