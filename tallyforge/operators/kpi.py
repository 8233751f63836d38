"""Key figures found by column type and by business role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import (
    first_rows, clamp, col, confidence_label, direction, growth, numeric_columns, ratio, text_columns, time_columns,
)
from tallyforge.functions.text import humanize_name
from tallyforge.operators import backbone as B, profile as P, trend as TR

_REVENUE_PER = {"Orders": ("Average Order Value", 88), "Customers": ("Revenue Per Customer", 86), "Products": ("Revenue Per Product", 86)}
KPI_SCHEMA = ["kpi", "value", "source_columns", "confidence"]


def roles_of(columns: list[str]) -> dict[str, list[str]]:
    """Role -> columns whose name holds one of its keywords."""
    plain = {c: c.lower().replace("_", " ") for c in columns}
    return {r: [c for c in columns if any(k in plain[c] for k in words)] for r, words in L.ROLE_KEYWORDS.items()}


def _first(roles: dict[str, list[str]], role: str, allowed: list[str]) -> str | None:
    return next((c for c in roles.get(role, []) if c in allowed), None)


def choose_measure(df: DataFrame) -> str | None:
    roles, numbers = roles_of(df.columns), numeric_columns(df)
    picks = (_first(roles, r, numbers) for r in L.MEASURE_PRIORITY)
    return next((p for p in picks if p), numbers[0] if numbers else None)


def choose_dimension(df: DataFrame) -> str | None:
    roles, texts = roles_of(df.columns), text_columns(df)
    picks = (_first(roles, r, texts) for r in L.DIMENSION_PRIORITY)
    return next((p for p in picks if p), texts[0] if texts else None)


def choose_time(df: DataFrame) -> str | None:
    times = time_columns(df)
    return times[0] if times else None


Items = list[tuple[str, Column, list[str], int]]


def _rows(df: DataFrame, items: Items) -> DataFrame:
    """One aggregation, one row per (name, value, sources, confidence); values without data are left out."""
    if not items:
        return _empty(df)
    structs = [
        F.struct(
            F.lit(name).alias("kpi"), F.round(value.cast("double"), 2).alias("value"),
            F.array(*[F.lit(s) for s in sources]).alias("source_columns"),
            F.lit(confidence).cast("long").alias("confidence"),
        )
        for name, value, sources, confidence in items
    ]
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s")).where("value IS NOT NULL")


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "kpi string, value double, source_columns array<string>, confidence long"
    )


def dynamic_kpis(df: DataFrame, measures: int | None = None, dimensions: int | None = None, limit: int | None = None) -> DataFrame:
    """Totals (means for rates and scores) of measures, distinct counts of dimensions."""
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])[F.col("column")]
    found = P.inspect_dataset(df).withColumn("position", order)
    is_measure = F.col("column_group") == "numeric"
    averaged = F.col("analytic_type").isin("rate", "score")
    label = F.initcap(F.translate("column", "_", " "))
    complete = F.col("completeness")
    rows = found.where((is_measure & F.col("total").isNotNull() & F.col("mean").isNotNull())
                       | (F.col("analytic_type") == "dimension"))
    named = rows.select(
        F.when(is_measure, 0).otherwise(1).alias("kind"), "position",
        F.when(is_measure & averaged, F.concat(label, F.lit(" Average")))
        .when(is_measure, F.concat(label, F.lit(" Total")))
        .otherwise(F.concat(F.lit("Unique "), label)).alias("kpi"),
        F.round(F.when(is_measure & averaged, F.col("mean")).when(is_measure, F.col("total"))
                .otherwise(F.col("unique_count")), 2).alias("value"),
        F.array("column").alias("source_columns"),
        F.when(is_measure & averaged, "mean").when(is_measure, "sum").otherwise("nunique").alias("aggregation"),
        F.round(F.when(is_measure, clamp(complete * complete, 0.55, 0.98)).otherwise(clamp(complete, 0.55, 0.95)) * 100)
        .cast("long").alias("confidence"),
    )
    # One row per column of the table: the window is bounded by the header.
    rank = F.row_number().over(W.partitionBy("kind").orderBy("position"))
    most = F.when(F.col("kind") == 0, F.lit(measures)).otherwise(F.lit(dimensions))
    kept = named.withColumn("rank", rank).where(most.isNull() | (F.col("rank") <= most))
    return first_rows(kept.orderBy("kind", "position"), limit).select("kpi", "value", "source_columns", "aggregation", "confidence")


def discovered_kpis(df: DataFrame, time: str | None = None) -> DataFrame:
    """(kpi, value, text): counts, health, totals, averages, top categories and slopes."""
    numbers = [c for c in numeric_columns(df) if not P.is_id_name(c)]
    texts = text_columns(df)
    none = F.lit(None).cast("string")

    def single(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
        structs = [
            F.struct(F.lit(k).alias("kpi"), F.col(c).cast("double").alias("value"), none.alias("text")) for k, c in pairs
        ]
        return frame.select(F.inline(F.array(*structs)))

    parts = [
        single(P.shape(df), [("Row Count", "rows"), ("Column Count", "columns")]),
        single(P.missing_summary(df), [("Missing %", "missing_percentage")]),
        single(P.duplicate_rows(df), [("Duplicate %", "duplicate_percent")]),
    ]
    if numbers:
        parts.append(single(P.health_score_weighted(df, numbers), [("Data Health Score", "health_score")]))
        stats = B.numeric_stats(df, numbers)
        business = F.lower("column").rlike("|".join(L.BUSINESS_NAME_HINTS))
        parts.append(stats.select(
            F.inline(F.array(
                F.struct(F.concat_ws(" ", "column", F.when(business, "Total").otherwise("Sum")).alias("kpi"),
                         F.round("total", 2).alias("value"), none.alias("text")),
                F.struct(F.concat(F.col("column"), F.lit(" Average")).alias("kpi"),
                         F.round("mean", 2).alias("value"), none.alias("text")),
            ))
        ))
        if time:
            parts.append(TR.linear_trend(df, time, numbers, min_points=3).where("slope_per_day IS NOT NULL").select(
                F.concat(F.col("measure"), F.lit(" Trend (slope/day)")).alias("kpi"),
                F.round("slope_per_day", 4).alias("value"), none.alias("text"),
            ))
    if texts:
        parts.append(P.categorical_kpis(df, texts).select(
            F.inline(F.array(
                F.struct(F.concat(F.lit("Top "), "column").alias("kpi"), F.lit(None).cast("double").alias("value"),
                         F.col("top_category").alias("text")),
                F.struct(F.concat(F.lit("Top "), F.col("column"), F.lit(" %")).alias("kpi"),
                         F.round("top_category_percentage", 2).alias("value"), none.alias("text")),
            ))
        ))
    return reduce(DataFrame.unionByName, parts)


def role_totals(df: DataFrame) -> DataFrame:
    """Sum of the first numeric column of each money and volume role."""
    return _rows(df, _role_totals(df))


def _role_totals(df: DataFrame) -> Items:
    roles, numbers = roles_of(df.columns), numeric_columns(df)
    found = [(r, _first(roles, r, numbers)) for r in L.SUM_ROLES]
    return [(r, F.sum(col(c)), [c], 88) for r, c in found if c]


def role_distinct(df: DataFrame) -> DataFrame:
    """Distinct values of the first column of each entity role, from one FREQ job."""
    roles = roles_of(df.columns)
    found = {r: _first(roles, r, df.columns) for r in L.DISTINCT_ROLES}
    found = {r: c for r, c in found.items() if c}
    if not found:
        return _empty(df)
    pairs = F.array(*[F.struct(F.lit(r).alias("kpi"), F.lit(c).alias("c")) for r, c in found.items()])
    counts = B.distinct_counts(df, list(dict.fromkeys(found.values())))
    named = counts.withColumn("p", F.explode(F.filter(pairs, lambda p: p["c"] == F.col("column"))))
    return named.select(
        F.col("p.kpi").alias("kpi"), F.col("unique_count").cast("double").alias("value"),
        F.array("column").alias("source_columns"), F.lit(82).cast("long").alias("confidence"),
    )


def margin(df: DataFrame) -> DataFrame:
    """Profit, or revenue less cost, in percent of |revenue|."""
    return _rows(df, _margin(df))


def _margin(df: DataFrame) -> Items:
    roles, numbers = roles_of(df.columns), numeric_columns(df)
    revenue, profit, cost = (_first(roles, r, numbers) for r in ("Revenue", "Profit", "Cost"))
    if revenue and profit:
        value = ratio(F.sum(col(profit)), F.abs(F.sum(col(revenue)))) * 100
        return [("Margins", value, [profit, revenue], 90)]
    if revenue and cost:
        value = ratio(F.sum(col(revenue)) - F.sum(col(cost)), F.abs(F.sum(col(revenue)))) * 100
        return [("Margins", value, [revenue, cost], 84)]
    return []


def average_rates(df: DataFrame) -> DataFrame:
    """Mean of the conversion and of the rating column."""
    return _rows(df, _average_rates(df))


def _average_rates(df: DataFrame) -> Items:
    roles, numbers = roles_of(df.columns), numeric_columns(df)
    items = []
    for role, name, confidence in (("Conversion Rate", "Conversion Rate", 82), ("Ratings", "Average Rating", 84)):
        c = _first(roles, role, numbers)
        if c:
            items.append((name, F.avg(col(c)), [c], confidence))
    return items


def _revenue_per(df: DataFrame, role: str) -> Items:
    name, confidence = _REVENUE_PER[role]
    roles = roles_of(df.columns)
    revenue, entity = _first(roles, "Revenue", numeric_columns(df)), _first(roles, role, df.columns)
    if not revenue or not entity:
        return []
    return [(name, ratio(F.sum(col(revenue)), B.unique_values(df, entity)), [revenue, entity], confidence)]


def average_order_value(df: DataFrame) -> DataFrame:
    return _rows(df, _revenue_per(df, "Orders"))


def revenue_per_customer(df: DataFrame) -> DataFrame:
    return _rows(df, _revenue_per(df, "Customers"))


def revenue_per_product(df: DataFrame) -> DataFrame:
    return _rows(df, _revenue_per(df, "Products"))


def inventory_turnover(df: DataFrame) -> DataFrame:
    """Units sold per mean stock."""
    return _rows(df, _inventory_turnover(df))


def _inventory_turnover(df: DataFrame) -> Items:
    roles, numbers = roles_of(df.columns), numeric_columns(df)
    units, stock = _first(roles, "Units", numbers), _first(roles, "Inventory", numbers)
    if not units or not stock:
        return []
    return [("Inventory Turnover", ratio(F.sum(col(units)), F.avg(col(stock))), [units, stock], 76)]


def monthly_kpis(df: DataFrame, measure: str, time: str) -> DataFrame:
    """(period, value, growth_percent, moving_forecast) per month; windows run on the monthly rows only."""
    monthly = B.time_series(df, time, [measure], "M").withColumnRenamed(measure, "value")
    order = W.orderBy("start")
    three = order.rowsBetween(-2, 0)
    return monthly.select(
        "period", F.round("value", 2).alias("value"),
        growth(F.col("value"), F.lag("value").over(order)).alias("growth_percent"),
        F.when(F.count(F.lit(1)).over(three) == 3, F.round(F.avg("value").over(three), 2)).alias("moving_forecast"),
    )


def growth_rate(df: DataFrame, measure: str, time: str) -> DataFrame:
    """Last month against the month before."""
    return monthly_kpis(df, measure, time).agg(
        F.max_by("growth_percent", "period").alias("value"), F.count(F.lit(1)).alias("n")
    ).where("n >= 2 AND value IS NOT NULL").select(
        F.lit("Growth Rate").alias("kpi"), "value", F.array(F.lit(measure), F.lit(time)).alias("source_columns"),
        F.lit(82).cast("long").alias("confidence"),
    )


def moving_forecast(df: DataFrame, measure: str, time: str) -> DataFrame:
    """Mean of the last three monthly sums."""
    return monthly_kpis(df, measure, time).agg(F.max_by("moving_forecast", "period").alias("value")).where(
        "value IS NOT NULL"
    ).select(
        F.lit("Forecast Revenue").alias("kpi"), "value", F.array(F.lit(measure), F.lit(time)).alias("source_columns"),
        F.lit(70).cast("long").alias("confidence"),
    )


def sales_velocity(df: DataFrame, units: str, time: str) -> DataFrame:
    """Units per day between the first and the last time stamp (at least one day)."""
    return _rows(df, _sales_velocity(units, time))


def _sales_velocity(units: str, time: str) -> Items:
    micros = F.unix_micros(col(time).cast("timestamp"))
    days = F.greatest(F.floor((F.max(micros) - F.min(micros)) / F.lit(86400000000)), F.lit(1))
    return [("Sales Velocity", ratio(F.sum(col(units)), days), [units, time], 78)]


def business_kpis(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All role-based key figures that the columns allow; those that are one sum over the rows come from one aggregation."""
    roles, numbers, time = roles_of(df.columns), numeric_columns(df), choose_time(df)
    revenue, units = _first(roles, "Revenue", numbers), _first(roles, "Units", numbers)
    places: list[tuple[int, Items]] = [
        (0, _role_totals(df)), (2, _margin(df)), (3, _average_rates(df)), *[(4 + i, _revenue_per(df, role)) for i, role in enumerate(_REVENUE_PER)],
        (7, _inventory_turnover(df)), (10, _sales_velocity(units, time) if time and units else []),
    ]
    items = [(f"{place:02d}{name}", *rest) for place, some in places for name, *rest in some]
    placed = _rows(df, items).withColumn("_order", F.substring("kpi", 1, 2).cast("int")).withColumn("kpi", F.expr("substring(kpi, 3)"))
    found = [placed, role_distinct(df).withColumn("_order", F.lit(1))]
    if time and revenue:
        found += [growth_rate(df, revenue, time).withColumn("_order", F.lit(8)), moving_forecast(df, revenue, time).withColumn("_order", F.lit(9))]
    all_rows = reduce(DataFrame.unionByName, found)
    if not any(roles.values()) and numbers:
        items = [(f"{humanize_name(c)} Total", F.sum(col(c)), [c], 70) for c in numbers]
        all_rows = _rows(df, items).withColumn("_order", F.lit(0))
    return first_rows(all_rows.orderBy("_order", F.desc("confidence"), "kpi"), limit).drop("_order")


def enrich_kpis(kpis: DataFrame, trends: DataFrame, forecasts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """KPI rows with the trend and forecast of their first source column.

    ``kpis``: keys..., kpi, value, aggregation, confidence, source_columns.
    ``trends``: keys..., column, trend, previous. ``forecasts``: keys..., column, predicted_value, change_percent.
    """
    keys = list(keys)
    base = kpis.withColumn("column", F.col("source_columns")[0])
    joined = base.join(trends.select(*keys, "column", "trend", "previous"), [*keys, "column"], "left").join(
        forecasts.select(*keys, "column", "predicted_value", "change_percent"), [*keys, "column"], "left"
    )
    trend = F.coalesce(
        F.when(F.col("trend") != 0, F.col("trend")), F.col("change_percent"), F.lit(0.0)
    )
    return joined.select(
        *keys, "kpi", "value", "column", F.round(trend, 2).alias("trend"), direction(trend).alias("trend_direction"),
        F.col("previous").alias("previous_value"), F.col("predicted_value").alias("forecast"), "confidence",
        confidence_label(F.col("confidence")).alias("confidence_label"),
        ((F.col("aggregation") == "nunique") | (trend > 0)).alias("is_good"),
        (F.col("predicted_value").isNotNull() | (trend != 0)).alias("should_act"),
        F.when(F.col("change_percent") >= 0, "prepare_capacity").when(F.col("change_percent") < 0, "investigate_decline")
        .when(trend < 0, "recover").when(trend > 0, "scale_driver").otherwise("compare_segments").alias("action"),
    )
