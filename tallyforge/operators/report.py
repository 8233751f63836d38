"""Recommendations and executive output from insight tables of many data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import confidence_label
from tallyforge.functions.text import contains_any, humanize
from tallyforge.operators import profile as P

KEY = "dataset_id"
_WEIGHT = {"High": 3, "Medium": 2, "Low": 1}


def priority_weight(priority: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in _WEIGHT.items() for x in (F.lit(k), F.lit(v))])[priority], F.lit(1))


def recommend_from_insights(insights: DataFrame) -> DataFrame:
    """One recommendation per insight by the words of its title; insights without evidence or match give none."""
    low = F.lower("title")
    kind = F.coalesce(*[
        F.when(contains_any(low, words) | (contains_any(F.lower("observation"), ["growth"]) if name == "growth" else F.lit(False))
               | (F.exists("evidence", lambda e: F.contains(F.lower(e["kpi"]), F.lit("missing"))) if name == "missing" else F.lit(False)), name)
        for name, words, *_ in L.RECOMMENDATIONS
    ], F.when(F.size("evidence") > 0, "evidence"))
    numeric = F.filter("evidence", lambda e: e["value"].isNotNull())
    severity = F.array_max(F.transform(numeric, lambda e: F.when(e["value"].between(0, 100), e["value"] / 100).otherwise(0.5)))
    metric = F.get(numeric, F.lit(0))["kpi"]
    typed = insights.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("severity", severity).withColumn(
        "metric", F.when(F.size(numeric) > 0, metric)
    )

    def choose(field: int, concentration: Column, evidence: Column) -> Column:
        out = F.when(F.col("kind") == "concentration", concentration)
        for name, *rest in L.RECOMMENDATIONS[1:]:
            out = out.when(F.col("kind") == name, rest[field])
        return out.otherwise(evidence)

    conf = F.col("confidence")
    titled = choose(
        1,
        F.when(contains_any(F.coalesce("metric", F.lit("")), ["revenue", "total"]), "Revenue Concentration Risk")
        .otherwise(F.concat(F.lit("Concentration Risk: "), F.coalesce(humanize(F.col("metric")), "title"))),
        F.concat(F.lit("Action: "), humanize(F.col("title"))),
    )
    outcome = F.create_map(*[x for k, v in L.EXPECTED_OUTCOMES.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    return typed.select(
        KEY, "rank", titled.alias("title"), "observation", "evidence",
        choose(3, F.when(F.coalesce("severity", F.lit(0.0)) >= 0.5, L.CONCENTRATION_IMPACT_HIGH).otherwise(L.CONCENTRATION_IMPACT_MEDIUM),
               F.lit(L.EVIDENCE_IMPACT)).alias("business_impact"),
        choose(2, F.lit(L.RECOMMENDATIONS[0][3]), F.lit(L.EVIDENCE_ACTION)).alias("recommended_action"),
        outcome.alias("expected_outcome"),
        F.when((F.col("severity") >= 0.6) | (conf >= 0.85), "High").when(conf >= 0.65, "Medium").otherwise("Low").alias("priority"),
        F.round(conf * 100).cast("long").alias("confidence"),
    )


def rank_recommendations(recommendations: DataFrame) -> DataFrame:
    """The first recommendation of each title, by priority and confidence."""
    rest = [c for c in recommendations.columns if c not in (KEY, "title")]
    first = recommendations.groupBy(KEY, "title").agg(F.min_by(F.struct(*rest), "rank").alias("r")).select(KEY, "title", "r.*")
    order = W.partitionBy(KEY).orderBy(F.desc(priority_weight(F.col("priority"))), F.desc("confidence"), "rank")
    return first.withColumn("place", F.row_number().over(order))


def prioritized(insights: DataFrame, limit: int | None = None) -> DataFrame:
    """An action plan per insight by the words of the finding; the best ``limit`` per data set where the caller asks for that."""
    finding = F.lower(F.coalesce("observation", "title"))
    focus = humanize(F.coalesce(F.get("evidence", F.lit(0))["kpi"], F.col("title")))
    problem, dependent, growing = (contains_any(finding, w) for w in (L.PROBLEM_WORDS, L.CONCENTRATION_WORDS, L.GROWTH_WORDS))
    action = (
        F.when(problem, F.concat(F.lit("Assign an owner to fix the "), focus, F.lit(" issue this week, validate the affected rows, and protect the highest-value segment before the next reporting cycle.")))
        .when(dependent, F.concat(F.lit("Reduce dependence on "), focus, F.lit(" by creating two growth plays for the next-best segments and shifting promotion, inventory, or sales effort toward them.")))
        .when(growing, F.concat(F.lit("Double down on "), focus, F.lit(": allocate more stock, sales attention, or campaign budget to the segment driving the improvement, then measure lift over the next period.")))
        .otherwise(F.concat(F.lit("Turn the "), focus, F.lit(" signal into an operating move: segment the affected rows, prioritize the largest business driver, and launch one targeted action in the next planning cycle.")))
    )
    impact = F.when(F.lower("impact").startswith("high"), "High").otherwise("Medium")
    score = F.round(F.col("confidence") * 100).cast("long")
    revenue = F.when(~problem & ~dependent & growing, "High").otherwise("Medium")
    plan = insights.select(
        KEY, "rank", F.concat(F.lit("Act on "), humanize(F.col("title"))).alias("title"),
        F.coalesce("observation", "title").alias("finding"), action.alias("recommended_action"), impact.alias("expected_impact"),
        score.alias("confidence"), F.when(problem | dependent, "High").otherwise("Medium").alias("risk_reduction"),
        revenue.alias("revenue_increase"), F.when(revenue == "High", "Medium").otherwise("Low").alias("profit_increase"),
        F.when(impact == "High", "7-14 days").otherwise("2-4 weeks").alias("implementation_time"),
        F.when((impact == "High") & (score >= 75), "High").otherwise("Medium").alias("roi"),
        confidence_label(score).alias("confidence_label"), F.size("evidence").alias("evidence_count"),
    )
    order = W.partitionBy(KEY).orderBy(F.desc(priority_weight(F.col("expected_impact"))), F.desc("confidence"), "rank")
    return plan.withColumn("place", F.row_number().over(order)).where(F.lit(True) if limit is None else F.col("place") <= limit)


def normalize_recommendations(df: DataFrame) -> DataFrame:
    """Fill title, detail and impact from their alternates."""
    def first(names: list[str], fallback: str) -> Column:
        found = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*found, F.lit(fallback))

    return df.select(
        *[c for c in df.columns if c not in ("title", "detail", "impact")],
        first(["title", "action"], "Recommended action").alias("title"),
        first(["detail", "recommended_action", "observation", "expected_outcome"], "Review the supporting evidence before acting.").alias("detail"),
        first(["impact", "priority", "business_impact"], "Medium").alias("impact"),
    )


def executive_outputs(quality: DataFrame, insights: DataFrame, anomalies: DataFrame, movements: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per data set: score, label, trend, strongest opportunity and risk, number of actions.

    ``quality``: dataset_id, missing_percent, duplicate_percent.
    """
    per_anomaly = anomalies.groupBy(KEY).agg(F.count(F.lit(1)).alias("anomalies"))
    best = insights.groupBy(KEY).agg(F.min_by("title", "rank").alias("opportunity"))
    rising = movements.groupBy(KEY).agg(F.bool_or(F.col("trend") > 0).alias("rising"))
    acts = plans.groupBy(KEY).agg(
        F.least(F.count(F.lit(1)), F.lit(3)).alias("action_count"),
        F.bool_or((F.col("place") <= 3) & (F.col("revenue_increase") == "High")).alias("_lift"),
    )
    joined = quality.join(per_anomaly, KEY, "left").join(best, KEY, "left").join(rising, KEY, "left").join(acts, KEY, "left")
    n = F.coalesce("anomalies", F.lit(0))
    score, label = P.executive_health(F.col("missing_percent"), F.col("duplicate_percent"), n)
    incomplete = F.col("missing_percent") > 5
    risk = F.when(incomplete, "Data completeness risk").when(n > 0, "Anomaly risk").otherwise("No major risk detected in the current analysis")
    trend = F.when(F.col("rising"), "Improving").when((n > 0) | incomplete, "Needs attention").otherwise("Stable")
    return joined.select(
        KEY, label.alias("business_health"), score.alias("overall_score"), trend.alias("current_trend"),
        F.coalesce("opportunity", F.lit("Build more history for stronger growth signals")).alias("top_opportunity"), risk.alias("top_risk"),
        F.coalesce("action_count", F.lit(0)).cast("long").alias("action_count"),
        F.when(F.col("_lift"), "High").otherwise("Medium").alias("expected_revenue_growth"),
        F.when(score >= 75, "High").otherwise("Medium").alias("overall_confidence"),
    )


def distinct_modes(insights: DataFrame, movements: DataFrame) -> DataFrame:
    """(dataset_id, business, eli5): a summary per audience, from the first insight and the first four figures."""
    lead = insights.groupBy(KEY).agg(F.min_by("observation", "rank").alias("lead"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("column", "kpi", "value"))), 1, 4)
    figures = movements.groupBy(KEY).agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(": ", x["kpi"], x["value"].cast("string"))), ", ").alias("figures"))
    return lead.join(figures, KEY, "left").select(
        KEY, F.concat(F.col("lead"), F.lit(" KPI focus: "), F.coalesce("figures", F.lit("No business KPI detected")),
                      F.lit(". Prioritize actions that improve growth, profitability, and risk control.")).alias("business"),
        F.concat(F.lit("Think of the data like a shop notebook. The biggest clue is: "), F.col("lead")).alias("eli5"),
    )


def qa_checks(quality: DataFrame, kpis: DataFrame, insights: DataFrame, plans: DataFrame) -> DataFrame:
    """(dataset_id, six checks, passed)."""
    k = kpis.groupBy(KEY).agg(F.count(F.lit(1)).alias("kpis"), F.bool_and(F.col("value").isNotNull()).alias("filled"), F.count("trend").alias("cards"))
    i = insights.where("rank <= 8").groupBy(KEY).agg(F.bool_and(F.size("evidence") > 0).alias("grounded"))
    p = plans.groupBy(KEY).agg(F.bool_and((F.col("evidence_count") > 0) | F.col("finding").isNotNull()).alias("backed"))
    checks = quality.join(k, KEY, "left").join(i, KEY, "left").join(p, KEY, "left").select(
        KEY, (F.coalesce("kpis", F.lit(0)) > 0).alias("kpi_non_empty"), F.coalesce("filled", F.lit(True)).alias("kpi_values_not_null"),
        F.coalesce("grounded", F.lit(False)).alias("insights_grounded"), F.coalesce("backed", F.lit(True)).alias("recommendations_grounded"),
        (F.coalesce("cards", F.lit(0)) > 0).alias("trend_cards_present"), (F.col("rows") > 0).alias("dataset_integrity"),
    )
    passed = F.lit(True)
    for c in checks.columns[1:]:
        passed = passed & F.col(c)
    return checks.withColumn("passed", passed)


def _top(df: DataFrame, order: list, n: int | None) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(KEY).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("_n") <= n)


def advisor_actions(anomalies: DataFrame, forecasts: DataFrame, plans: DataFrame, limit: int | None = None,
                    most: tuple[int | None, int | None, int | None] = (None, None, None)) -> DataFrame:
    """Ranked actions from anomalies, forecasts and recommendations per data set; ``most`` limits each kind and ``limit`` all."""
    def act(df: DataFrame, source: str, title: Column, score: Column, priority: Column | None = None) -> DataFrame:
        level = F.when(score >= 85, "High").when(score >= 65, "Medium").otherwise("Low")
        return df.select(KEY, humanize(title).alias("title"), score.cast("long").alias("confidence"),
                         (level if priority is None else priority).alias("priority"), F.lit(source).alias("source"))

    parts = [
        act(_top(anomalies, [F.desc("confidence"), F.asc("column")], most[0]), "anomaly_engine", F.col("column"), F.col("confidence")),
        act(_top(forecasts, [F.asc("column")], most[1]), "forecast_engine", F.col("column"), F.col("confidence_score")),
        act((plans if most[2] is None else plans.where(F.col("place") <= most[2])), "recommendation_engine", F.col("title"), F.col("confidence")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = [F.desc(priority_weight(F.col("priority"))), F.desc("confidence"), F.asc("source"), F.asc("title")]
    return _top(every, order, limit).withColumnRenamed("_n", "rank")


def lifecycle(shape: DataFrame, domains: DataFrame, health: DataFrame, models: DataFrame, insights: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per run: size, domain, health, models used and the summary line."""
    used = models.groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models_used"))
    i = insights.groupBy(KEY).agg(F.count(F.lit(1)).alias("insights"))
    p = plans.groupBy(KEY).agg(F.count(F.lit(1)).alias("plans"))
    joined = shape
    for other in (domains, health, used, i, p):
        joined = joined.join(other, KEY, "left")
    return joined.select(
        KEY, "rows", "columns", F.coalesce("domain", F.lit("custom")).alias("domain"), "overall_health_score", "models_used",
        F.format_string("%d rows, %d columns, %d insights, %d recommendations", F.col("rows"), F.col("columns"),
                        F.coalesce("insights", F.lit(0)), F.coalesce("plans", F.lit(0))).alias("summary"),
    )


def report(latest: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(user_id, dataset_id, section, rank, text) of the newest run of every user."""
    out = None
    for name, df in sections.items():
        part = latest.select("user_id", KEY).join(df, KEY).select("user_id", KEY, F.lit(name).alias("section"), "rank", "text")
        out = part if out is None else out.unionByName(part)
    return out


def basic_insights(insights: DataFrame, premium: Column, limit: int = L.BASIC_INSIGHT_LIMIT) -> DataFrame:
    """All insights for paid plans, the first three otherwise."""
    return insights.where(premium | (F.col("rank") <= limit))
