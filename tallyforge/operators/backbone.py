"""The three shared jobs most operators read from: STATS, FREQ and TIME.

STATS is one scan with one output row per column, FREQ one combined count per
(column, value), TIME one zero-filled daily series per measure and group.

Where many operators read one written table, ``remember`` it: each shared job then runs once, over all
columns of its kind, and its result (some rows per column, or one per distinct text or day) is kept in the checkpoint folder.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tallyforge.functions.quantile import exact_quantiles
from tallyforge.functions.semantics import (
    GRAINS, INTEGRAL_TYPES, STEP, any_of, col, numeric_columns, period_label, period_start, skew_corrected, text_columns, total_of,
)
from tallyforge.session import checkpoint_frame

_KNOWN: weakref.WeakKeyDictionary[DataFrame, dict] = weakref.WeakKeyDictionary()
_WIDE = 40


def remember(df: DataFrame) -> DataFrame:
    """``df``, a written table that many operators read: the shared jobs over it run once as long as it is in use."""
    _KNOWN.setdefault(df, {})
    return df


def known(df: DataFrame) -> bool:
    return df in _KNOWN


def fact(df: DataFrame, name: object, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` makes; of a remembered table it is computed once under ``name``."""
    if df not in _KNOWN:
        return build()
    found = _KNOWN[df]
    if name not in found:
        found[name] = checkpoint_frame(build())
    return found[name]


def _by_column(df: DataFrame, name: str, columns: list[str], every: list[str], build: Callable[[list[str]], DataFrame]) -> DataFrame:
    """A job with rows per ``column``; of a remembered table it runs once over ``every`` and the rows of ``columns`` are taken."""
    if df not in _KNOWN or not set(columns) <= set(every):
        return build(columns)
    return fact(df, name, lambda: build(every)).where(F.col("column").isin(*columns))


def identifier_name(name: str) -> bool:
    """Numeric columns of such a name are identifiers by ``profile.analytic_type``."""
    return name.lower().endswith("id")


def per_value(df: DataFrame, columns: list[str], aggs: list[Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """(column, value as text, aggs...) of the non-null values of each column; ``aggs`` read what ``keep`` names.

    One pass over all columns; a remembered table of up to 40 columns is stored by columns, so there each column is read and grouped on its own.
    """
    kept = [c.alias(k) for k, c in (keep or {}).items()]
    if df in _KNOWN and len(columns) <= _WIDE:
        parts = [df.select(F.lit(c).alias("column"), col(c).cast("string").alias("value"), *kept).where("value IS NOT NULL").groupBy("column", "value").agg(*aggs) for c in columns]
        return reduce(DataFrame.unionByName, parts)
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns], *kept)
    long = texts.unpivot([*(keep or {})], [col(c) for c in columns], "column", "value").where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(*aggs)


def _unique(df: DataFrame, name: str) -> DataFrame:
    """(column, unique_count) of one column: values grouped by their own type where each has its own text, else as text."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, (*INTEGRAL_TYPES, T.DecimalType, T.DateType, T.BooleanType)):
        keys = [c.alias("v")]
    elif isinstance(kind, (T.DoubleType, T.FloatType)):  # 0 and -0 are two texts and one number
        keys = [c.alias("v"), F.when(c == 0, c.cast("string")).startswith("-").alias("negative")]
    else:
        keys = [c.cast("string").alias("v")]
    values = df.select(*keys).where("v IS NOT NULL").distinct()
    return values.agg(F.count(F.lit(1)).alias("unique_count")).select(F.lit(name).alias("column"), "unique_count")


def unique_values(df: DataFrame, name: str) -> Column:
    """The number of distinct values of a column, for use in an aggregation; of a remembered table it is looked up."""
    if df in _KNOWN and isinstance(df.schema[name].dataType, (*INTEGRAL_TYPES, T.StringType, T.DateType)):
        return F.max(distinct_counts(df, [name]).select("unique_count").scalar())
    return F.count_distinct(col(name))


def _long(df: DataFrame, columns: list[str], measures: dict[str, object], by: list[str] = ()) -> DataFrame:
    """One aggregation over all columns, turned into one row per (by..., column)."""
    aggs = [
        F.struct(F.lit(c).alias("column"), *[make(col(c)).alias(name) for name, make in measures.items()])
        for c in columns
    ]
    wide = df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*aggs).alias("_stats")
    )
    return wide.select(*[col(b) for b in by], "rows", F.inline("_stats"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """STATS for numeric columns: count, sum, mean, spread, extremes and corrected skew, in one scan."""
    columns = columns or numeric_columns(df)
    if not by and known(df):
        return _by_column(df, "stats", columns, numeric_columns(df), lambda every: _numeric_stats(df, every, []))
    return _numeric_stats(df, columns, list(by))


def _numeric_stats(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    def number(make):
        return lambda c: make(c.cast("double"))

    return _long(
        df, columns,
        {
            "n": F.count,
            "total": number(lambda c: F.coalesce(F.sum(c), F.lit(0.0))),
            "mean": number(F.avg),
            "std": number(F.stddev_samp),
            "variance": number(F.var_samp),
            "std_pop": number(F.stddev_pop),
            "min": number(F.min),
            "max": number(F.max),
            "skew": number(skew_corrected),
        },
        by,
    )


def quartiles(df: DataFrame, columns: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """(by..., column, n, q1, median, q3)."""
    columns = columns or numeric_columns(df)
    if by or not known(df):
        found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], list(by))
    else:
        found = _by_column(df, "quartiles", columns, [c for c in numeric_columns(df) if not identifier_name(c)], lambda every: exact_quantiles(df, every, [0.25, 0.5, 0.75]))
    q = F.col("q")
    return found.select(*by, "column", "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """STATS joined with the quartiles; one row per column, so the right side is tiny."""
    stats = numeric_stats(df, columns)
    return stats.join(F.broadcast(quartiles(df, columns).drop("n")), "column", "left")


def missing_stats(df: DataFrame) -> DataFrame:
    """(column, rows, non_null, missing) for every column, in one scan."""
    return fact(df, "missing", lambda: _long(df, df.columns, {"non_null": F.count})).withColumn("missing", F.col("rows") - F.col("non_null"))


def row_missing_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, rows with any null, columns with any null, empty columns."""
    nulls = [col(c).isNull() for c in df.columns]
    counts = [F.count(col(c)) for c in df.columns]
    rows = F.count(F.lit(1))
    return fact(df, "row_missing", lambda: df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        total_of([rows - c for c in counts]).cast("long").alias("missing_cells"),
        F.count_if(any_of(nulls)).alias("missing_rows"),
        total_of([(c < rows).cast("int") for c in counts]).cast("long").alias("missing_columns"),
        total_of([(c == 0).cast("int") for c in counts]).cast("long").alias("empty_columns"),
    ))


def duplicate_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows and duplicate_rows (repeats of an earlier identical row; NULL equals NULL).

    Rows are compared by two 64-bit hashes of their values and of where NULLs are, so 16 bytes of a row travel, whatever
    its width; two different rows of a billion agree in both with a chance of about one in 10^20. Arrays and structs, whose
    hash does not tell where a NULL is inside, are compared as they are. Equal rows are combined before the shuffle.
    """
    columns = columns or df.columns
    nested = [c for c in columns if df.schema[c].dataType.simpleString().startswith(("array", "struct"))]
    plain = [col(c) for c in columns if c not in nested]
    nulls = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in plain])
    keys = [F.xxhash64(*plain, nulls).alias("_a"), F.xxhash64(F.lit(1), nulls, *plain).alias("_b"), *[col(c) for c in nested]]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return fact(df, ("duplicates", *columns), lambda: counted.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """The repeated rows with their ``copies``; exact, but only suspects travel at full width.

    Pass 1 groups an 8-byte row hash; pass 2 groups whole rows whose hash occurred
    more than once, so a hash clash costs time and never a wrong count.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[col(c) for c in df.columns]))
    suspects = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    return (
        hashed.join(suspects, "_h", "left_semi")
        .groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """FREQ: (column, value, records) over the non-null values of each column, as text."""
    return _by_column(df, "frequency", columns, text_columns(df), lambda every: per_value(df, every, [F.count(F.lit(1)).alias("records")]))


def frequency_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, top_value, top_records, unique_count, non_null); ties go to the smallest value.

    Built from FREQ with combinable aggregates only, so no column is sorted in one task.
    """
    best = F.min(F.struct((-F.col("records")).alias("k"), F.col("value").alias("v")))
    found = frequency(df, columns).groupBy("column").agg(
        best.alias("_best"), F.count(F.lit(1)).alias("unique_count"), F.sum("records").alias("non_null")
    )
    return found.select(
        "column", F.col("_best.v").alias("top_value"), (-F.col("_best.k")).alias("top_records"),
        "unique_count", "non_null",
    )


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values per column with rank and totals (``row_number <= k`` is pushed before the shuffle)."""
    freq = frequency(df, columns)
    totals = freq.groupBy("column").agg(F.sum("records").alias("non_null"), F.count(F.lit(1)).alias("unique_count"))
    order = W.partitionBy("column").orderBy(F.desc("records"), F.asc("value"))
    best = freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(totals), "column")


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, rows, unique_count, non_null)."""
    columns = columns or df.columns
    if approximate:
        return _long(df, columns, {"unique_count": F.approx_count_distinct, "non_null": F.count})
    if known(df) and len(df.columns) <= _WIDE:
        texts = text_columns(df)
        parts = [frequency(df, texts).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))] if texts else []
        freq = fact(df, "unique", lambda: reduce(DataFrame.unionByName, parts + [_unique(df, c) for c in df.columns if c not in texts]))
        base = missing_stats(df).where(F.col("column").isin(*columns)).select("column", "rows", "non_null")
    else:
        freq = frequency(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        base = missing_stats(df.select(*[col(c) for c in columns])).select("column", "rows", "non_null")
    return base.join(F.broadcast(freq), "column", "left").select(
        "column", "rows", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "non_null"
    )


def period_sums(df: DataFrame, time: str, measures: list[str], grain: str, by: list[str] = ()) -> DataFrame:
    """(by..., start, measures...): plain sums per period that has rows."""
    by = list(by)
    if known(df) and not by and set(measures) <= set(numeric_columns(df)) - {"start"} and "start" not in numeric_columns(df):
        # all grains are made of days
        daily = fact(df, ("days", time), lambda: period_sums(df.select("*"), time, numeric_columns(df), "D"))
        rolled = daily if grain == "D" else daily.groupBy(period_start(F.col("start"), grain).alias("start")).agg(*[F.sum(col(m)).alias(m) for m in measures])
        return rolled.select("start", *[col(m) for m in measures])
    return (
        df.where(col(time).isNotNull())
        .groupBy(*[col(b) for b in by], period_start(col(time), grain).alias("start"))
        .agg(*[F.coalesce(F.sum(col(m)), F.lit(0)).cast("double").alias(m) for m in measures])
    )


def fill_periods(sums: DataFrame, grain: str, measures: list[str], by: list[str] = (), position: str | None = None) -> DataFrame:
    """Add the empty periods between the first and the last of each series with sum 0; ``position`` names a column of 0-based positions.

    Every period brings the empty ones before the next, so no calendar is joined and only periods with rows are shuffled and sorted. Runs on
    aggregated rows: a series is at most its calendar. A series without name (a NULL key) has no sums to match and is 0 throughout.
    """
    by = list(by)
    order, step = W.partitionBy(*by).orderBy("start"), F.expr(f"INTERVAL {STEP[grain]}")
    after = sums.withColumn("_next", F.lead("start").over(order))
    spans = after.withColumn("_span", F.sequence("start", F.coalesce(F.col("_next") - step, F.col("start")), step))
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    own = [F.col("_span").alias("_starts"), F.coalesce(F.sum(F.size("_span")).over(ahead), F.lit(0)).alias("_from")]
    every = spans.select(*by, *measures, *own).select(*by, *measures, "_from", F.posexplode("_starts").alias("_i", "start"))
    named = total_of([col(b).isNull().cast("int") for b in by] or [F.lit(0)]) == 0
    return every.select(
        *by, "start", period_label(F.col("start"), grain).alias("period"),
        *[F.when(named & (F.col("_i") == 0), col(m)).otherwise(0.0).alias(m) for m in measures],
        *([(F.col("_from") + F.col("_i")).cast("double").alias(position)] if position else []),
    )


def time_series(df: DataFrame, time: str, measures: list[str], grain: str = "D", by: list[str] = (), position: str | None = None) -> DataFrame:
    """TIME: (by..., start, period, measures..., position) with empty periods as 0."""
    return fill_periods(period_sums(df, time, measures, grain, by), grain, measures, by, position)


def roll_up(daily: DataFrame, measures: list[str], grain: str, by: list[str] = ()) -> DataFrame:
    """A coarser series from the daily one; no second scan of the data."""
    by = list(by)
    return (
        daily.groupBy(*by, F.date_trunc(GRAINS[grain], "start").alias("start"))
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(*by, "start", period_label(F.col("start"), grain).alias("period"), *measures)
    )


def series_position(by: list[str], descending: bool = False) -> Column:
    """0-based position of a period in its (aggregated) series."""
    order = F.desc("start") if descending else F.asc("start")
    return F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
