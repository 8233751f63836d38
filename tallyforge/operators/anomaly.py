"""Unusual values, rows and moves by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions.semantics import col, numeric_columns, percent, ratio
from tallyforge.functions.text import humanize, slug
from tallyforge.operators import backbone as B, profile as P, trend as TR


def _scored(df: DataFrame, columns: list[str], table: DataFrame | None = None) -> DataFrame:
    """Attach mean and sample deviation of every column as one scalar struct ``_m``; ``table``: where they are taken, if not from ``df``."""
    row = B.numeric_stats(df if table is None else table, columns).agg(*[
        F.max(F.when(F.col("column") == c, F.col(of))).alias(f"{name}_{i}")
        for i, c in enumerate(columns) for name, of in (("mean", "mean"), ("std", "std"), ("n", "n"))
    ])
    return df.withColumn("_m", row.select(F.struct(*row.columns).alias("m")).scalar())


def _z(i: int, c: str, min_values: int) -> Column:
    z = ratio(col(c).cast("double") - F.col(f"_m.mean_{i}"), F.col(f"_m.std_{i}"))
    return F.when(F.col(f"_m.n_{i}") >= min_values, z)


def zscore(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, min_values: int = 4, strict: bool = False
) -> DataFrame:
    """(column, high, low, anomalies): values at least ``threshold`` deviations from the mean."""
    columns = columns or numeric_columns(df)
    found = []
    for i, c in enumerate(columns):
        z = _z(i, c, min_values)
        high, low = (z > threshold, z < -threshold) if strict else (z >= threshold, z <= -threshold)
        found.append(F.struct(F.lit(c).alias("column"), F.count_if(high).alias("high"), F.count_if(low).alias("low")))
    counted = _scored(df, columns).agg(F.array(*found).alias("s")).select(F.inline("s"))
    return counted.withColumn("anomalies", F.col("high") + F.col("low"))


def iqr_anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, lower_bound, upper_bound, outliers, percent)."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return P.outlier_counts(df, columns).withColumn("percent", percent(F.col("outliers"), rows, 1))


def rule_anomalies(
    df: DataFrame, order_by: list[str], bucket: Column, columns: list[str] | None = None, z_threshold: float = 3.0, table: DataFrame | None = None
) -> DataFrame:
    """Distinct unusual rows per column by four rules, with severity and confidence.

    ``table``: the table whose rows ``df`` has, where it is one with known statistics.
    """
    columns = columns or numeric_columns(df)
    table = df if table is None else table
    narrow = df.select(*dict.fromkeys([*order_by, *columns]))
    changed = TR.with_pct_change(narrow, columns, order_by, bucket)
    marked = P.with_bounds(_scored(changed, columns, table), P.iqr_bounds(table, columns), columns)
    beyond = P.outside(columns)
    found = []
    for i, c in enumerate(columns):
        rules = {
            "iqr": beyond[i],
            "sudden_drop": F.coalesce(col(f"chg_{c}") <= -0.5, F.lit(False)),
            "sudden_spike": F.coalesce(col(f"chg_{c}") >= 1.0, F.lit(False)),
            "z_score": F.coalesce(F.abs(_z(i, c, 4)) >= z_threshold, F.lit(False)),
        }
        hit = rules["iqr"] | rules["sudden_drop"] | rules["sudden_spike"] | rules["z_score"]
        methods = F.concat_ws(", ", *[F.when(F.count_if(r) > 0, name) for name, r in rules.items()])
        found.append(F.struct(
            F.lit(c).alias("column"), methods.alias("type"), F.count_if(hit).alias("anomaly_count"),
            F.count(F.lit(1)).alias("rows"), F.count(col(c)).alias("n"),
        ))
    counted = marked.agg(F.array(*found).alias("s")).select(F.inline("s")).where("n >= 4 AND anomaly_count > 0")
    share = percent(F.col("anomaly_count"), F.col("rows"), 4)
    level = severity(share, F.col("anomaly_count"))
    return counted.select(
        "column", "type", "anomaly_count", share.alias("anomaly_percent"), level.alias("severity"),
        severity_confidence(level).alias("confidence_score"),
    )


def severity(share: Column, count: Column) -> Column:
    return F.when((share >= 5) | (count >= 25), "high").when(share >= 1, "medium").otherwise("low")


def severity_confidence(level: Column) -> Column:
    return F.when(level == "high", 82).when(level == "medium", 72).otherwise(62).cast("long")


def imputed(df: DataFrame, columns: list[str], keep: list[str] = (), holes: list[str] | None = None) -> DataFrame:
    """Columns as double with NULL replaced by the column median (0 when a column is empty).

    ``holes``: the columns that hold NULLs, where known; no median is computed of the others.
    """
    if holes == []:
        return df.select(*[col(k) for k in keep], *[col(c).cast("double").alias(c) for c in columns])
    medians = B.quartiles(df, holes or columns)
    row = medians.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"m{i}") for i, c in enumerate(columns)])
    packed = row.select(F.struct(*row.columns).alias("m")).scalar()
    filled = df.withColumn("_med", packed)
    return filled.select(
        *[col(k) for k in keep],
        *[F.coalesce(col(c).cast("double"), F.col(f"_med.m{i}"), F.lit(0.0)).alias(c) for i, c in enumerate(columns)],
    )


def row_zscore(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, top: int = 4) -> DataFrame:
    """(column, rank, mean_abs_z, anomaly_count, anomaly_percent): rows unusual in any column and what drives them."""
    columns = columns or numeric_columns(df)
    scored = _scored(imputed(df, columns), columns)
    zs = scored.select(*[F.abs(_z(i, c, 1)).alias(f"z{i}") for i, c in enumerate(columns)])
    hit = F.coalesce(F.greatest(*zs.columns) if len(columns) > 1 else F.col("z0"), F.lit(0.0)) >= threshold
    stats = zs.agg(
        F.count_if(hit).alias("anomaly_count"), F.count(F.lit(1)).alias("rows"),
        F.array(*[
            F.struct(F.avg(F.when(hit, F.col(f"z{i}"))).alias("z"), F.lit(c).alias("column"))
            for i, c in enumerate(columns)
        ]).alias("s"),
    )
    ranked = stats.where("anomaly_count > 0").select(
        "anomaly_count", percent(F.col("anomaly_count"), F.col("rows"), 2).alias("anomaly_percent"),
        F.posexplode(F.slice(F.reverse(F.array_sort(F.filter("s", lambda x: x["z"].isNotNull()))), 1, top)),
    )
    return ranked.select(
        (F.col("pos") + 1).alias("rank"), F.col("col.column").alias("column"),
        F.round("col.z", 4).alias("mean_abs_z"), "anomaly_count", "anomaly_percent",
    )


def enrich_anomalies(anomalies: DataFrame, facts: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Business wording for detector rows of many data sets.

    ``anomalies``: key, column, severity (nullable), confidence, anomaly_count, anomaly_percent.
    ``facts``: one row per key with measure, dimension, leader, lift_percent and change_percent.
    Repeats of one event (same headline and column) are dropped.
    """
    joined = anomalies.join(facts, key, "left")
    focus = humanize(F.col("column"))
    level = F.coalesce(F.lower("severity"), F.when(F.col("confidence") >= 85, "high").otherwise("medium"))
    moved = F.abs("change_percent") >= 20
    led = F.abs("lift_percent") >= 25
    size = F.abs("change_percent").cast("string")
    headline = (
        F.when(moved, F.concat(humanize(F.col("measure")), F.when(F.col("change_percent") > 0, " Jumped ").otherwise(" Dropped "),
                               size, F.lit("% Recently")))
        .when(led, F.concat(humanize(F.col("measure")), F.lit(" Is Unusually Concentrated in "), "leader"))
        .otherwise(F.concat(focus, F.lit(" Needs Immediate Attention")))
    )
    impact = (
        F.when(moved, F.when(F.abs("change_percent") >= 35, "High").otherwise("Medium"))
        .otherwise(F.when(level == "high", "High").otherwise("Medium"))
    )
    named = joined.select(
        key, "column", headline.alias("headline"), impact.alias("business_impact"), level.alias("severity"),
        F.when(impact == "High", "Medium exposure").otherwise("Low to medium exposure").alias("estimated_loss"),
        "confidence", "anomaly_count", "anomaly_percent",
    ).withColumn("event_key", slug(F.concat_ws(" ", "headline", "column")))
    rest = [c for c in named.columns if c not in (key, "event_key")]
    # The strongest row of each event, by a combinable aggregate.
    best = F.max_by(F.struct(*rest), F.struct("confidence", F.coalesce("anomaly_count", F.lit(0)), "column"))
    return named.groupBy(key, "event_key").agg(best.alias("b")).select(key, "event_key", "b.*")


def root_causes(anomalies: DataFrame, kpis: DataFrame, roles: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Affected KPIs and possible causes per anomaly.

    ``kpis``: key, kpi, column (one row per source column). ``roles``: key, role.
    """
    affected = kpis.groupBy(key, "column").agg(F.array_sort(F.collect_set("kpi")).alias("kpis"))
    present = roles.groupBy(key).agg(
        F.bool_or(F.col("role").isin("Orders", "Customers")).alias("demand"),
        F.bool_or(F.col("role").isin("Inventory", "Products")).alias("stock"),
        F.bool_or(F.col("role").isin("Cost", "Profit", "Margins")).alias("money"),
    )
    joined = anomalies.join(affected, [key, "column"], "left").join(present, key, "left")
    causes = F.concat_ws(
        "; ",
        F.when(F.col("demand"), "order volume or customer mix changed"),
        F.when(F.col("stock"), "product availability or inventory mix changed"),
        F.when(F.col("money"), "cost, margin, or pricing pressure changed"),
    )
    return joined.select(
        key, "column",
        F.when(causes == "", "source data, outlier rows, or upstream transformation changed").otherwise(causes).alias("possible_causes"),
        F.coalesce(F.array_join("kpis", ", "), "column").alias("affected_metrics"),
        "severity", F.when(F.col("severity") == "high", 72).otherwise(62).cast("long").alias("confidence"),
    )


def kpi_move_flags(growth: DataFrame, threshold: float = 35.0) -> DataFrame:
    """KPI moves of at least +-``threshold`` percent."""
    return growth.where(F.abs("growth_percent") >= threshold).withColumn(
        "severity", F.when(F.col("growth_percent") > 0, "positive").otherwise("negative")
    )
