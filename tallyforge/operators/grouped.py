"""Grouped sums, top-k, concentration and correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col, numeric_columns, percent, ratio, text_columns
from tallyforge.operators import backbone as B


def group_sums(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """(label, amount): sum of the measure per value; rows without either are left out."""
    used = df.where(col(dimension).isNotNull() & col(measure).isNotNull())
    return used.groupBy(col(dimension).cast("string").alias("label")).agg(
        F.sum(col(measure)).cast("double").alias("amount")
    )


def _grand_total(df: DataFrame, dimension: str, measure: str):
    """The total as a scalar subquery: one narrow scan instead of a window over all groups."""
    used = df.where(col(dimension).isNotNull() & col(measure).isNotNull())
    return used.agg(F.sum(col(measure)).cast("double").alias("t")).scalar()


def group_sum_rank(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """Groups by descending amount with their share of the total."""
    share = ratio(F.col("amount"), _grand_total(df, dimension, measure)) * 100
    return group_sums(df, dimension, measure).select(
        "label", F.round("amount", 2).alias("amount"), F.round(share, 2).alias("share")
    ).orderBy(F.desc("amount"), F.asc("label"))


def top_n(df: DataFrame, dimension: str, measure: str, n: int = 10) -> DataFrame:
    """The n largest groups with their share within those n."""
    n = max(1, n)
    best = group_sums(df, dimension, measure).orderBy(F.desc("amount"), F.asc("label")).limit(n)
    # The window below sees the n rows that were asked for.
    total = F.sum("amount").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc("amount"), F.asc("label")))
    return best.select(
        rank.alias("rank"), "label", F.round("amount", 2).alias("amount"),
        F.round(ratio(F.col("amount"), total) * 100, 1).alias("share"),
    )


def bottom_group(df: DataFrame, dimension: str, measure: str | None = None) -> DataFrame:
    """The weakest group by amount, or by records when no measure is given."""
    if measure is None:
        counted = B.frequency(df, [dimension]).select(
            F.col("value").alias("label"), F.col("records").cast("double").alias("amount")
        )
        total = df.agg(F.count(F.lit(1)).cast("double").alias("t")).scalar()
    else:
        counted = group_sums(df, dimension, measure)
        total = _grand_total(df, dimension, measure)
    return counted.orderBy(F.asc("amount"), F.asc("label")).limit(1).select(
        "label", F.round("amount", 2).alias("amount"), F.round(ratio(F.col("amount"), total) * 100, 1).alias("share")
    )


def concentration(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Top value, its share and the share of the top three, per text column."""
    columns = (columns or text_columns(df))[:limit]
    best = B.top_values(df, columns, 3)
    return best.groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
        F.round(F.max(F.when(F.col("rank") == 1, percent(F.col("records"), F.col("non_null")))), 2).alias("top_share"),
        F.round(percent(F.sum("records"), F.max("non_null")), 2).alias("top_3_share"),
    )


def pareto(df: DataFrame, dimension: str, measure: str, k: int = 3) -> DataFrame:
    """The k largest contributors with amount, share and cumulative share."""
    best = group_sums(df, dimension, measure).orderBy(F.desc("amount"), F.asc("label")).limit(k)
    total = _grand_total(df, dimension, measure)
    order = W.orderBy(F.desc("amount"), F.asc("label"))
    running = F.sum("amount").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return best.select(
        F.row_number().over(order).alias("rank"), "label", F.round("amount", 2).alias("amount"),
        F.round(ratio(F.col("amount"), total) * 100, 2).alias("share"),
        F.round(ratio(running, total) * 100, 2).alias("cumulative_share"),
    )


def value_counts(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column with their share of the non-null rows."""
    return B.top_values(df, columns or text_columns(df), k).select(
        "column", "rank", "value", "records", percent(F.col("records"), F.col("non_null"), 2).alias("share")
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, corr) of all column pairs; of each pair the rows with a null in either column are skipped.

    One rule at any width: each task adds up counts, sums, squares and products of all pairs as matrix products over its rows
    (shifted by about the median of the column, or by its mean where that is known, so large offsets do not cost digits), and the sums meet per pair. The number of
    rows shuffled is the number of pairs times the number of tasks. NULL where either column does not vary.
    """
    columns = columns or numeric_columns(df)
    if B.known(df) and set(columns) <= set(every := numeric_columns(df)) and [c for c in every if c in columns] == list(columns) and len(columns) > 1:
        found = B.fact(df, "correlations", lambda: _correlations(df, every))
        return found.where(F.col("col_a").isin(*columns) & F.col("col_b").isin(*columns))
    return _correlations(df, columns)


def _correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    if len(columns) < 2:
        return df.sparkSession.range(0).select(F.lit("").alias("col_a"), F.lit("").alias("col_b"), F.lit(0.0).alias("corr"))
    narrow = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    if B.known(df):
        means = {r["column"]: r["mean"] for r in B.numeric_stats(df, columns).select("column", "mean").collect()}
        middle = [means[c] for c in columns]
    else:
        middle = narrow.agg(*[F.percentile_approx(c, 0.5, 100) for c in narrow.columns]).first()
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in middle])
    left, right = np.triu_indices(len(columns), 1)

    def sums(batches):
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x]
        parts = [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *[pa.array(t[left, right]) for t in total]]
        yield pa.RecordBatch.from_arrays(parts, ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    kinds = ", ".join(["a int", "b int", *[f"{s} double" for s in ("n", "x", "y", "xx", "yy", "xy")]])
    added = narrow.mapInArrow(sums, kinds).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y, xx, yy, xy = (F.col(s) for s in ("n", "x", "y", "xx", "yy", "xy"))
    spread = (xx - x * x / n) * (yy - y * y / n)
    # what rounding leaves of a constant column is no variance
    varies = (n > 1) & (xx - x * x / n > xx * 1e-13) & (yy - y * y / n > yy * 1e-13)
    value = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - x * y / n) / F.sqrt(spread))))
    names = F.array(*[F.lit(c) for c in columns])
    return added.select(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), value.alias("corr"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Both triangles and the diagonal, 4 decimals."""
    columns = columns or numeric_columns(df)
    upper = correlation_pairs(df, columns)
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    same = df.agg(F.array(*[
        F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
                 F.when(F.var_pop(col(c).cast("double")) > 0, F.lit(1.0)).alias("corr"))
        for c in columns
    ]).alias("s")).select(F.inline("s"))
    return upper.unionByName(lower).unionByName(same).select("col_a", "col_b", F.round("corr", 4).alias("corr"))


def top_correlations(
    df: DataFrame, columns: list[str] | None = None, top: int = 10, threshold: float = 0.5
) -> DataFrame:
    """Of the ``top`` strongest pairs those with |r| at least ``threshold``."""
    ranked = correlation_pairs(df, columns).where(F.col("corr").isNotNull()).orderBy(
        F.desc(F.abs("corr")), F.asc("col_a"), F.asc("col_b")
    )
    return ranked.limit(top).where(F.abs("corr") >= threshold).select(
        "col_a", "col_b", F.round("corr", 4).alias("corr")
    )


def numeric_leaderboard(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Columns by total with their share of all totals; names that end in 'id' are left out."""
    columns = [c for c in columns or numeric_columns(df) if not c.lower().endswith("id")]
    # One row per column, so the unpartitioned window is bounded by the header.
    grand = F.sum("total").over(W.partitionBy())
    return (
        B.numeric_stats(df, columns)
        .select("column", "total", F.round(ratio(F.col("total"), grand) * 100, 1).alias("share"))
        .orderBy(F.desc("total"), F.asc("column")).limit(k)
        .withColumn("total", F.round("total", 2))
    )


def segment_revenue_share(df: DataFrame, columns: list[str], revenue: str, threshold: float = 40.0) -> DataFrame:
    """For columns whose top value holds at least ``threshold`` % of records: its share of revenue.

    One combined count-and-sum per (column, value); nothing is sorted.
    """
    sums = B.per_value(df, columns, [F.count(F.lit(1)).alias("records"), F.sum("_r").alias("amount")], {"_r": col(revenue).cast("double")})
    best = F.min(F.struct((-F.col("records")).alias("k"), F.col("value").alias("v"), F.col("amount").alias("a")))
    found = sums.groupBy("column").agg(
        best.alias("b"), F.sum("records").alias("non_null"), F.sum("amount").alias("total")
    )
    share = percent(-F.col("b.k"), F.col("non_null"), 1)
    return found.select(
        "column", F.col("b.v").alias("top_value"), share.alias("top_share"),
        F.round(ratio(F.col("b.a"), F.col("total")) * 100, 1).alias("revenue_share"),
    ).where(F.col("top_share") >= threshold)


def mean_vs_median(df: DataFrame, measure: str) -> DataFrame:
    return B.numeric_summary(df, [measure]).select(
        "column", F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median")
    )
