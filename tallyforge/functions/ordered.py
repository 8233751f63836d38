"""Order-dependent steps that never put a whole group into one task.

A plain ``lag`` over (partition by key order by time) sorts one key in one task.
These helpers cut each key into buckets of the order column, run the window
inside a bucket and carry one row per bucket across bucket borders.
``bucket`` must be monotone in ``order_by``, for example the day of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col


def _attach(rows: DataFrame, carried: DataFrame, keys: list[str]):
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return rows.alias("l").join(carried.alias("r"), condition, "left")


def bucketed_previous(
    df: DataFrame, values: list[str], order_by: list[str], bucket: Column, by: list[str] = (), prefix: str = "prev_"
) -> DataFrame:
    """Add ``<prefix><value>``: the last non-null value before each row, per key."""
    by = list(by)
    keys = by + ["_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = tagged.select("*", *[
        F.last(col(v), ignorenulls=True).over(inner).alias(f"_in_{i}") for i, v in enumerate(values)
    ])
    # the last row of a bucket knows the last value; numbers keep the aggregation free of sorting, and rows are shuffled once
    ends = inside.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))).groupBy(*keys).agg(*[
        F.max_by(F.coalesce(col(v), F.col(f"_in_{i}")), "_at").alias(f"_end_{i}") for i, v in enumerate(values)
    ])
    carried = ends.select(*keys, *[
        F.last(f"_end_{i}", ignorenulls=True).over(earlier).alias(f"_carry_{i}") for i in range(len(values))
    ])
    previous = [
        F.coalesce(F.col(f"l._in_{i}"), F.col(f"r._carry_{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)
    ]
    # without keys there is one row for each bucket
    return _attach(inside, carried if by else F.broadcast(carried), keys).select(*[F.col(f"l.`{c}`") for c in df.columns], *previous)


def bucketed_running_max(
    df: DataFrame, value: str, order_by: list[str], bucket: Column, by: list[str] = (), alias: str = "running"
) -> DataFrame:
    """Add the largest ``value`` up to and including each row, per key."""
    by = list(by)
    keys = by + ["_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tagged.groupBy(*keys).agg(F.max(col(value)).alias("_top")).select(
        *keys, F.max("_top").over(earlier).alias("_carry")
    )
    inside = tagged.withColumn("_inside", F.max(col(value)).over(inner))
    return _attach(inside, carried, keys).select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        F.greatest(F.col("l._inside"), F.col("r._carry")).alias(alias),
    )
