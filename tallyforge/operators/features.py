"""Feature columns: imputation, standard scores, one-hot of frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions.semantics import col, ratio
from tallyforge.operators import backbone as B
from tallyforge.operators.anomaly import imputed


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL -> column median; other columns are kept."""
    return imputed(df, columns, [c for c in df.columns if c not in columns])


def impute_by_group(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """NULL -> median of the row's group, else of the whole column."""
    grouped = B.quartiles(df, columns, [by]).groupBy(by).agg(*[
        F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_g{i}") for i, c in enumerate(columns)
    ])
    overall = B.quartiles(df, columns).agg(*[
        F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"o{i}") for i, c in enumerate(columns)
    ])
    packed = overall.select(F.struct(*overall.columns).alias("o")).scalar()
    joined = df.join(grouped, by, "left").withColumn("_o", packed)
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*[col(c) for c in rest], *[
        F.coalesce(col(c).cast("double"), F.col(f"_g{i}"), F.col(f"_o.o{i}"), F.lit(0.0)).alias(c)
        for i, c in enumerate(columns)
    ])


def standardize(df: DataFrame, columns: list[str], limit: int | None = None, suffix: str = "_scaled") -> DataFrame:
    """Add (x - mean) / population deviation; a constant column becomes 0."""
    columns = columns[:limit]
    row = df.agg(*[
        x for i, c in enumerate(columns) for x in (
            F.avg(col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(col(c).cast("double")).alias(f"s{i}"),
        )
    ])
    packed = row.select(F.struct(*row.columns).alias("p")).scalar()
    shifted = df.withColumn("_p", packed)
    scaled = [
        F.when(col(c).isNotNull(), F.coalesce(ratio(col(c) - F.col(f"_p.m{i}"), F.col(f"_p.s{i}")), F.lit(0.0))).alias(f"{c}{suffix}")
        for i, c in enumerate(columns)
    ]
    return shifted.select(*[col(c) for c in df.columns], *scaled)


def one_hot_top(df: DataFrame, columns: list[str], k: int = 6, limit: int | None = None) -> DataFrame:
    """Add a 0/1 column per frequent value, named ``column_value``; NULL counts as 'Unknown'.

    The vocabulary (at most k values per column) is collected, the rows are not.
    """
    columns = columns[:limit]
    known = df.select(*[F.coalesce(col(c).cast("string"), F.lit("Unknown")).alias(c) for c in columns])
    found = B.top_values(known, columns, k).select("column", "rank", "value").collect()
    added = []
    for c in columns:
        value = F.coalesce(col(c).cast("string"), F.lit("Unknown"))
        for r in sorted((r for r in found if r["column"] == c), key=lambda r: r["rank"]):
            name = f"{c}_{r['value'][:24]}".replace(" ", "_")
            added.append((value == r["value"]).cast("int").alias(name))
    return df.select("*", *added)
