"""Aggregated chart series: what is drawn, never how."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col, numeric_columns, ratio, text_columns
from tallyforge.operators import backbone as B, grouped as G, profile as P, trend as TR


def _ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[
        x for i, c in enumerate(columns) for x in (
            F.min(col(c).cast("double")).alias(f"lo_{i}"), F.max(col(c).cast("double")).alias(f"hi_{i}"),
        )
    ])
    return df.withColumn("_r", row.select(F.struct(*row.columns).alias("r")).scalar())


def _bin(i: int, c: str, bins: int):
    """0-based equal-width bin; the maximum belongs to the last bin."""
    lo, hi = F.col(f"_r.lo_{i}"), F.col(f"_r.hi_{i}")
    place = F.floor(F.coalesce(ratio(col(c).cast("double") - lo, hi - lo), F.lit(0.0)) * bins)
    return F.when(col(c).isNotNull(), F.least(place, F.lit(bins - 1)))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 28) -> DataFrame:
    """(column, bin, low, high, records) for all columns from one combined count."""
    columns = columns or numeric_columns(df)
    ranged = _ranges(df, columns)
    placed = ranged.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _bin(i, c, bins).alias("bin"),
                 F.col(f"_r.lo_{i}").alias("lo"), F.col(f"_r.hi_{i}").alias("hi"))
        for i, c in enumerate(columns)
    ]))).where("bin IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    return placed.groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("records")).select(
        "column", "bin", F.round(F.col("lo") + F.col("bin") * width, 4).alias("low"),
        F.round(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("high"), "records",
    )


def box(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the bounds) and the number of outlier points."""
    columns = columns or numeric_columns(df)
    marked = P.with_bounds(df, P.iqr_bounds(df, columns), columns)
    beyond = P.outside(columns)
    found = [
        F.struct(
            F.lit(c).alias("column"), F.min(F.when(~out, col(c).cast("double"))).alias("whisker_low"),
            F.max(F.when(~out, col(c).cast("double"))).alias("whisker_high"), F.count_if(out).alias("outliers"),
        )
        for c, out in zip(columns, beyond)
    ]
    counted = marked.agg(F.array(*found).alias("s")).select(F.inline("s"))
    return B.quartiles(df, columns).join(F.broadcast(counted), "column").select(
        "column", *[F.round(n, 4).alias(n) for n in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers"
    )


def outlier_points(df: DataFrame, column: str) -> DataFrame:
    """The rows beyond the whiskers of one column."""
    marked = P.with_bounds(df, P.iqr_bounds(df, [column]), [column])
    return marked.where(P.outside([column])[0]).drop("_b")


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, records): the point cloud as a grid, so its size is fixed."""
    ranged = _ranges(df, [x, y])
    return (
        ranged.select(_bin(0, x, bins).alias("x_bin"), _bin(1, y, bins).alias("y_bin"))
        .where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
        .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("records"))
    )


def bar(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    return G.value_counts(df, columns or text_columns(df), k).drop("share")


def pie(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """Shares among the shown values; a column with a single value has no pie."""
    shown = W.partitionBy("column")
    counted = G.value_counts(df, columns or text_columns(df), k)
    return counted.select(
        "column", "rank", "value", "records",
        F.round(F.col("records") * 100.0 / F.sum("records").over(shown), 2).alias("share"),
        F.count(F.lit(1)).over(shown).alias("_n"),
    ).where("_n > 1").drop("_n")


def line(df: DataFrame, time: str, measures: list[str], grain: str = "D") -> DataFrame:
    """(measure, period, value) over time at a chosen grain."""
    series = TR.resample_sum(df, time, measures, grain)
    return series.unpivot(["period"], measures, "measure", "value")


def line_by_row(df: DataFrame, measure: str, order_by: str, points: int = 500) -> DataFrame:
    """(slot, rows, mean_value): the values in row order, averaged in at most ``points`` equal ranges of ``order_by``."""
    ranged = _ranges(df.where(col(measure).isNotNull()), [order_by])
    return ranged.groupBy(_bin(0, order_by, points).alias("slot")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(col(measure)), 4).alias("mean_value")
    )


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return G.correlation_matrix(df, columns)
