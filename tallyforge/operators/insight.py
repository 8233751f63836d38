"""Findings from signals: evidence insights, scores and sentence variants.

Signals are tables keyed by ``dataset_id``, so one job covers many data sets.
An insight row is: dataset_id, rank, title, observation, impact, recommendation,
confidence and evidence (an array of kpi / value pairs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.lookups import FINDING_ACTIONS, PHRASES
from tallyforge.functions.semantics import col, numeric_columns, percent, ratio, text_columns
from tallyforge.functions.text import first_sentence, humanize, humanize_acronyms
from tallyforge.operators import anomaly as A, backbone as B, grouped as G, profile as P, trend as TR
from tallyforge.session import checkpoint_frame

KEY = "dataset_id"


# ---------------------------------------------------------------- signals of many data sets

def pareto_signal(df: DataFrame, dimension: str, measure: str, key: str = KEY) -> DataFrame:
    """(key, dimension, measure, leader, leader_share, top_3_share) of every data set."""
    sums = df.where(col(dimension).isNotNull()).groupBy(key, col(dimension).cast("string").alias("label")).agg(
        F.sum(col(measure)).alias("amount")
    )
    order = W.partitionBy(key).orderBy(F.desc("amount"), F.asc("label"))
    best = sums.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    totals = sums.groupBy(key).agg(F.sum("amount").alias("total"))
    lead = F.max(F.when(F.col("rank") == 1, F.struct("amount", "label")))
    return best.join(totals, key).groupBy(key).agg(
        lead.alias("b"), F.sum("amount").alias("three"), F.max("total").alias("total")
    ).where("total <> 0").select(
        key, F.lit(dimension).alias("dimension"), F.lit(measure).alias("measure"), F.col("b.label").alias("leader"),
        F.round(ratio(F.col("b.amount"), F.col("total")) * 100, 2).alias("leader_share"),
        F.round(ratio(F.col("three"), F.col("total")) * 100, 2).alias("top_3_share"),
    )


def concentration_signal(df: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """(key, column, top_value, top_share, top_3_share)."""
    counts = df.where(col(column).isNotNull()).groupBy(key, col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = W.partitionBy(key).orderBy(F.desc("n"), F.asc("value"))
    best = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return best.join(totals, key).groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("n", "value"))).alias("b"), F.sum("n").alias("three"), F.max("total").alias("total")
    ).select(
        key, F.lit(column).alias("column"), F.col("b.value").alias("top_value"),
        percent(F.col("b.n"), F.col("total"), 2).alias("top_share"), percent(F.col("three"), F.col("total"), 2).alias("top_3_share"),
    )


def anomaly_signal(df: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """(key, column, anomaly_count, anomaly_percent, severity, confidence) by the quartile rule per data set."""
    bounds = P.iqr_bounds(df, columns, 1.5, [key])
    wide = bounds.groupBy(key).agg(*[
        x for i, c in enumerate(columns) for x in (
            F.max(F.when(F.col("column") == c, F.col("lower"))).alias(f"lo{i}"),
            F.max(F.when(F.col("column") == c, F.col("upper"))).alias(f"hi{i}"),
        )
    ])
    # One row per data set on the right; its size decides the join at run time.
    joined = df.select(key, *[col(c) for c in columns]).join(wide, key)
    counted = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[
            F.struct(F.lit(c).alias("column"), F.count_if((col(c) < F.col(f"lo{i}")) | (col(c) > F.col(f"hi{i}"))).alias("anomaly_count"))
            for i, c in enumerate(columns)
        ]).alias("s"),
    ).select(key, "rows", F.inline("s")).where("anomaly_count > 0")
    share = percent(F.col("anomaly_count"), F.col("rows"), 4)
    level = A.severity(share, F.col("anomaly_count"))
    return counted.select(
        key, "column", "anomaly_count", share.alias("anomaly_percent"), level.alias("severity"),
        A.severity_confidence(level).alias("confidence"),
    )


def movement_signal(df: DataFrame, time: str, measures: list[str], grain: str = "MoM", key: str = KEY) -> DataFrame:
    """(key, column, kpi, value, trend, trend_direction, confidence) of the last period against the one before."""
    found = TR.period_growth(df, time, measures, [key]).where(F.col("grain") == grain)
    return found.select(
        key, F.col("measure").alias("column"), F.concat(humanize(F.col("measure")), F.lit(" Total")).alias("kpi"),
        F.col("current").alias("value"), F.col("growth_percent").alias("trend"),
        F.col("direction").alias("trend_direction"), F.lit(98).cast("long").alias("confidence"),
    )


# ---------------------------------------------------------------- insights

def _evidence(pairs: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(k.cast("string").alias("kpi"), v.cast("double").alias("value")) for k, v in pairs])


def _insight(df: DataFrame, kind: int, position: Column, title: Column, observation: Column, impact: str | Column,
             recommendation: Column, confidence: Column, evidence: Column, key: str) -> DataFrame:
    return df.select(
        key, F.lit(kind).alias("kind"), position.cast("string").alias("position"), title.alias("title"),
        observation.alias("observation"), (F.lit(impact) if isinstance(impact, str) else impact).alias("impact"),
        recommendation.alias("recommendation"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"),
    )


def _within(column: str, most: int | None) -> Column:
    """True for all rows, or up to a rank where the caller sets one."""
    return F.lit(True) if most is None else F.col(column) <= most


def evidence_insights(
    pareto: DataFrame, concentration: DataFrame, distribution: DataFrame, anomalies: DataFrame, movements: DataFrame,
    key: str = KEY, share: float = 65.0, skew: float = 1.25, limit: int | None = None,
    anomalies_most: int | None = None, movements_most: int | None = None,
) -> DataFrame:
    """Ranked insights per data set from five kinds of signals; at most ``limit`` where the caller asks for it."""
    top_n = F.row_number().over(W.partitionBy(key).orderBy("column"))
    col_label, measure_label = humanize(F.col("column")), humanize(F.col("measure"))
    text = F.col
    parts = [
        _insight(
            pareto, 0, text("dimension"), F.concat(measure_label, F.lit(" concentration")),
            F.concat(F.lit("Top 3 "), text("dimension"), F.lit(" values generate "), text("top_3_share").cast("string"), F.lit("% of "),
                     text("measure"), F.lit(". "), text("leader"), F.lit(" alone contributes "), text("leader_share").cast("string"), F.lit("%.")),
            "High concentration can make performance dependent on a narrow segment.",
            F.concat(F.lit("Monitor the top "), text("dimension"), F.lit(" contributors separately and grow the long tail to reduce dependency.")),
            F.lit(0.9), _evidence([(text("leader"), text("leader_share"))]), key,
        ),
        _insight(
            concentration.where(F.col("top_3_share") >= share), 1, text("column"), F.concat(col_label, F.lit(" concentration")),
            F.concat(F.lit("Top 3 values in "), col_label, F.lit(" represent "), text("top_3_share").cast("string"), F.lit("% of records. "),
                     text("top_value"), F.lit(" is the largest group at "), text("top_share").cast("string"), F.lit("%.")),
            "A concentrated segment can hide smaller but important groups.",
            F.concat(F.lit("Break reporting for "), col_label, F.lit(" into leader versus long-tail segments.")),
            F.lit(0.84), _evidence([(text("column"), text("top_3_share"))]), key,
        ),
        _insight(
            distribution.where(F.abs("skew") >= skew), 2, text("column"), F.concat(col_label, F.lit(" skew")),
            F.concat(col_label, F.lit(" is skewed ("), text("skew").cast("string"), F.lit("), so "),
                     F.when(F.col("skew") > 0, "large values pull averages upward").otherwise("small values pull averages downward"), F.lit(".")),
            "Average-based KPIs may be misleading for this metric.",
            F.concat(F.lit("Use median, percentiles, and segment-level views for "), col_label, F.lit(".")),
            F.lit(0.78), _evidence([(text("column"), text("skew"))]), key,
        ),
        _insight(
            anomalies.withColumn("_n", top_n).where(_within("_n", anomalies_most)), 3, text("column"), F.concat(F.lit("Anomaly in "), col_label),
            F.concat(text("column"), F.lit(" has "), text("anomaly_count").cast("string"), F.lit(" unusual values detected by iqr.")),
            "Unusual values can distort averages, totals, forecasts, and segment rankings.",
            F.concat(F.lit("Inspect source rows for "), col_label, F.lit(" before using this metric for decisions.")),
            F.lit(0.76), _evidence([(text("column"), text("anomaly_count"))]), key,
        ),
        _insight(
            movements.withColumn("_n", top_n).where(_within("_n", movements_most)).where("trend <> 0 AND trend_direction IN ('up', 'down')"), 4, text("column"),
            F.concat(text("kpi"), F.lit(" movement")),
            F.concat(text("kpi"), F.when(F.col("trend_direction") == "up", " increased by ").otherwise(" decreased by "),
                     text("trend").cast("string"), F.lit(" based on the detected comparison period.")),
            "Directional movement can affect revenue, profitability, capacity, or planning.",
            F.concat(F.lit("Review drivers behind "), text("kpi"), F.lit(" movement before setting targets.")),
            F.least(F.lit(0.9), F.col("confidence") / 100), _evidence([(text("kpi"), text("trend"))]), key,
        ),
    ]
    every = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(W.partitionBy(key).orderBy("kind", "position"))
    return every.withColumn("rank", rank).where(_within("rank", limit)).drop("kind", "position")


def score_insights(insights: DataFrame, coverage: Column | float = 0.5) -> DataFrame:
    """Add business_impact_score, importance and priority from confidence and evidence."""
    share = F.transform("evidence", lambda e: F.when(e["value"].between(0, 100), e["value"] / 100).when(e["value"].isNotNull(), 0.5).otherwise(0.0))
    strength = F.coalesce(F.array_max(share), F.lit(0.0))
    cover = F.lit(coverage) if isinstance(coverage, float) else coverage
    conf = F.col("confidence")
    impact = F.round(F.least(F.lit(100.0), strength * 60 + conf * 30 + cover * 10)).cast("long")
    importance = F.round(F.least(F.lit(100.0), impact * (1 + F.size("evidence") * 0.1))).cast("long")
    high = (impact >= 70) | ((conf >= 0.85) & (strength >= 0.4))
    priority = F.when(high, "High").when((impact >= 45) | (conf >= 0.65), "Medium").otherwise("Low")
    return insights.select(
        "*", impact.alias("business_impact_score"), importance.alias("importance"), priority.alias("priority"),
        F.round(conf * 100).cast("long").alias("confidence_score"),
    )


def with_reasoning(insights: DataFrame) -> DataFrame:
    """Add ``reasoning``: the evidence in words, or that the finding rests on the data set's signals; values left out where NULL."""
    named = F.transform("evidence", lambda e: F.concat(F.coalesce(e["kpi"], F.lit("")), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit(""))))
    based = F.concat(F.lit("Based on observed evidence: "), F.array_join(named, ", "))
    return insights.withColumn("reasoning", F.when(F.size("evidence") > 0, based).otherwise("Observation derived from dataset signals."))


def localize_modes(rendered: DataFrame, languages: tuple[str, ...] = ("hi", "hinglish")) -> DataFrame:
    """Add every mode of ``render_modes`` in further languages: known phrases are replaced, all else stays as it is."""
    def said(mode: str, language: str) -> Column:
        return reduce(lambda text, phrase: F.replace(text, F.lit(phrase[0]), F.lit(phrase[1])), PHRASES[language].items(), F.col(mode))

    modes = ("mode_business", "mode_data", "mode_eli5")
    return rendered.select("*", *[said(mode, language).alias(f"{mode}_{language}") for mode in modes for language in languages])


def render_modes(insights: DataFrame) -> DataFrame:
    """Add the business, data and simple wording of every insight."""
    pairs = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["kpi"], e["value"].cast("string"))), ", ")
    business = F.concat_ws(
        " ", "observation", "impact", F.concat(F.lit("Recommended action: "), F.col("recommendation"))
    )
    data = F.when(pairs != "", F.concat(F.col("observation"), F.lit(". Evidence: "), pairs)).otherwise(F.col("observation"))
    return insights.select(
        "*", business.alias("mode_business"), data.alias("mode_data"), first_sentence(F.col("observation")).alias("mode_eli5")
    )


def insight_battery(df: DataFrame, time: str | None = None, dataset_id: str = "table") -> DataFrame:
    """The general findings about one table: size, quality, totals, concentration, growth, correlation, extremes."""
    numbers = numeric_columns(df)
    named = [c for c in numbers if not c.lower().endswith("id")]
    texts = text_columns(df)
    none = F.lit(None).cast("string")

    def row(frame: DataFrame, order: int, title: Column, observation: Column, confidence: float, evidence: Column, impact: str | None = None,
            action: Column | str | None = None) -> DataFrame:
        return frame.select(
            F.lit(dataset_id).alias(KEY), F.lit(order).alias("section"), title.alias("title"), observation.alias("observation"),
            (F.lit(impact) if impact else none).alias("impact"),
            (none if action is None else F.lit(FINDING_ACTIONS[action]) if isinstance(action, str) else action).alias("recommendation"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"),
        )

    def about(action: str, label: Column) -> Column:
        return F.replace(F.lit(FINDING_ACTIONS[action]), F.lit("{}"), label)

    facts = B.row_missing_stats(df)
    parts = [row(
        facts, 0, F.lit("Executive summary"),
        F.format_string("This dataset contains %d records across %d columns. The analysis highlights prioritized opportunities, risks, and recommended next steps for business users.", "rows", "columns"),
        0.9, _evidence([(F.lit("row_count"), F.col("rows")), (F.lit("columns"), F.col("columns"))]),
    ), row(
        P.duplicate_rows(df, 1).where("duplicate_rows > 0"), 1, F.lit("Duplicate rows found"),
        F.format_string("There are %d duplicate rows (%.1f%%).", "duplicate_rows", "duplicate_percent"), 0.9,
        _evidence([(F.lit("duplicate_rows"), F.col("duplicate_rows")), (F.lit("duplicate_percent"), F.col("duplicate_percent"))]),
        "Duplicates may artificially increase totals and distort segment shares.", "duplicates",
    )]
    worst = P.missing_hotspots(df).agg(F.array_sort(F.collect_list(F.struct((-F.col("missing_percent")).alias("m"), "column"))).alias("w"))
    holes = worst.withColumn("cells", facts.select("missing_cells").scalar()).where("cells > 0")
    parts.append(row(
        holes, 2, F.lit("Missing data hotspots"),
        F.concat(F.col("cells").cast("string"), F.lit(" missing cells detected. Highest-missing columns: "),
                 F.array_join(F.transform("w", lambda x: F.concat(x["column"], F.lit(" ("), (-x["m"]).cast("string"), F.lit("%)"))), ", "), F.lit(".")),
        0.88, F.transform("w", lambda x: F.struct(x["column"].alias("kpi"), (-x["m"]).alias("value"))),
        "Missing cells reduce KPI reliability for affected segments.", "missing",
    ))
    if named:
        parts.append(row(
            P.health_score_weighted(df, named), 3, F.lit("Data health score"),
            F.concat(F.lit("Overall data health score is "), F.col("health_score").cast("string"), F.lit("/100.")), 0.85,
            _evidence([(F.lit("data_health.score"), F.col("health_score"))]), "Lower data health indicates greater effort required to trust KPIs.", "health",
        ))
        board = G.numeric_leaderboard(df, named, 5)
        label = humanize_acronyms(F.col("column"))
        parts.append(row(
            board, 4, F.concat(F.lit("Top numeric contributor: "), label),
            F.format_string("%s totals %,.0f, contributing %.1f%% of combined numeric totals.", label, F.col("total"), F.col("share")), 0.8,
            _evidence([(F.col("column"), F.col("total"))]),
            "High contribution indicates this metric drives totals and should be prioritized in drilling/forecasting.", about("contributor", label),
        ))
        parts.append(row(
            board.orderBy(F.desc("total"), F.asc("column")).limit(1), 9, F.concat(F.lit("Opportunity: focus on "), label),
            F.format_string("%s contributes the largest numeric total (%,.0f).", label, F.col("total")), 0.82,
            _evidence([(F.col("column"), F.col("total"))]), "Targeting the top contributor can yield outsized revenue or efficiency gains.", about("opportunity", label),
        ))
        extremes = A.zscore(df, named, 4.0, 10, strict=True).where("anomalies > 0")
        parts.append(row(
            extremes, 8, F.concat(F.lit("Anomalies in "), label),
            F.format_string("Detected %d high and %d low extreme values in %s.", F.col("high"), F.col("low"), label), 0.78,
            _evidence([(F.concat(F.lit("anomaly."), "column", F.lit(".high")), F.col("high")), (F.concat(F.lit("anomaly."), "column", F.lit(".low")), F.col("low"))]),
            "Outliers can distort aggregated KPIs and forecasts.", "anomalies",
        ))
    exact = ["revenue", "total_amount", "amount", "sales", "total"]
    money = next((c for w in exact for c in numbers if c.lower() == w), None) or next(
        (c for c in numbers if any(t in c.lower() for t in ("amount", "revenue", "sales", "total"))), None)
    if texts and money:
        label = humanize_acronyms(F.col("column"))
        parts.append(row(
            G.segment_revenue_share(df, texts, money), 5, F.concat(F.lit("Concentration: "), label),
            F.format_string("%s represents %.1f%% of %s values. It also accounts for %.1f%% of revenue.", "top_value", "top_share", "column", "revenue_share"), 0.9,
            _evidence([(F.concat(F.lit("concentration."), "column", F.lit(".top_share")), F.col("top_share")), (F.concat(F.lit("revenue_share_of_"), "top_value"), F.col("revenue_share"))]),
            "High concentration can indicate single points of failure or clear prioritization opportunities.", "concentration",
        ))
    trended = money or (named[0] if named else None)
    if time and trended:
        parts.append(row(
            TR.quarter_growth(df, time, trended), 6, F.lit(f"{trended.replace('_', ' ').capitalize()} growth"),
            F.concat(F.lit(f"{trended} has changed by "), F.col("growth_percent").cast("string"),
                     F.lit("% comparing the most recent 3-month period to the previous 3 months.")), 0.88,
            _evidence([(F.lit(trended), F.col("growth_percent"))]), "Recent growth may indicate accelerating demand or seasonality that affects planning.", "growth",
        ))
    if len(numbers) >= 2:
        a, b = humanize_acronyms(F.col("col_a")), humanize_acronyms(F.col("col_b"))
        parts.append(row(
            G.top_correlations(df, numbers, 5, 0.6), 7, F.concat(F.lit("Correlation: "), a, F.lit(" & "), b),
            F.format_string("%s is %s correlated with %s (r=%.2f).", a, F.when(F.col("corr") > 0, "positively").otherwise("negatively"), b, F.col("corr")), 0.8,
            _evidence([(F.concat_ws(".", F.lit("corr"), "col_a", "col_b"), F.abs(F.round("corr", 2)))]),
            "Correlation suggests a relationship worth investigating for causal links.", "correlation",
        ))
    found = checkpoint_frame(reduce(DataFrame.unionByName, parts))  # some dozens of rows, read for their number and as they are
    few = found.agg(F.count(F.lit(1)).alias("n")).where("n < 6")
    extra = row(
        few, 10, F.lit("Additional analysis recommended"),
        F.lit("Provide a larger dataset or include explicit business metrics (revenue, profit) to surface more prioritized business insights and trend forecasts."),
        0.5, F.expr("cast(array() as array<struct<kpi:string,value:double>>)"), None, "more_data",
    )
    return found.unionByName(extra)
