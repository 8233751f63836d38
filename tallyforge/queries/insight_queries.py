"""Insights, recommendations and reports over one data set per supplier."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import percent
from tallyforge.operators import anomaly as A, backbone as B, catalog as CA, forecast as FO, insight as I, kpi as K, profile as P, report as R, trend as TR
from tallyforge.plans import ask as ASK
from tallyforge.queries.base import VIEWS, Tables, query, sql
from tallyforge.queries.model_queries import domain_sql, keyword_rows
from tallyforge.queries.usage_queries import uploads, users
from tallyforge.session import staged_table

MEASURES = ["quantity", "revenue"]
SHARE, SKEW = 14.5, 1.25


class Signals:
    """The signal tables of every supplier. What several signals read is computed once and written."""

    def __init__(self, spark, sf):
        self.t = Tables(spark, sf)

    @cached_property
    def lines(self) -> DataFrame:
        return staged_table(self.t.supplier_lines)

    @property
    def pareto(self) -> DataFrame:
        return I.pareto_signal(self.lines, "brand", "revenue")

    @property
    def concentration(self) -> DataFrame:
        return I.concentration_signal(self.lines, "brand")

    @property
    def distribution(self) -> DataFrame:
        stats = B.numeric_stats(self.lines, ["revenue", "tail"], ["dataset_id"])
        return stats.select("dataset_id", "column", F.round("skew", 4).alias("skew"))

    @cached_property
    def anomalies(self) -> DataFrame:
        return staged_table(I.anomaly_signal(self.lines, ["revenue", "tail"]))

    @cached_property
    def movements(self) -> DataFrame:
        return staged_table(I.movement_signal(self.lines, "ship_date", MEASURES))

    @cached_property
    def insights(self) -> DataFrame:
        return staged_table(I.evidence_insights(self.pareto, self.concentration, self.distribution, self.anomalies, self.movements, share=SHARE, skew=SKEW))

    @property
    def plans(self) -> DataFrame:
        return R.prioritized(self.insights)

    @property
    def quality(self) -> DataFrame:
        """Every tenth order lacks its quantity; equal (brand, quantity) pairs count as repeats."""
        t = self.t
        lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("dataset_id"), "p_brand", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity")).alias("q"))
        pairs = lines.groupBy("dataset_id", "p_brand", "q").agg(F.count(F.lit(1)).alias("n"))
        facts = pairs.groupBy("dataset_id").agg(
            F.sum("n").alias("rows"), F.sum(F.when(F.col("q").isNull(), F.col("n")).otherwise(0)).alias("m"), F.sum(F.col("n") - 1).alias("d"))
        return facts.select("dataset_id", "rows", percent(F.col("m"), F.col("rows") * 2, 2).alias("missing_percent"),
                            percent(F.col("d"), F.col("rows") * 10, 2).alias("duplicate_percent"))

    @property
    def catalog(self) -> DataFrame:
        """The columns of every supplier's lines: a column belongs to a data set where it holds a value."""
        lines = self.lines.drop("dataset_id")
        kind = {name: "number" if t in ("double", "bigint", "int") else "time" if t.startswith("timestamp") else "text" for name, t in lines.dtypes}
        seen = self.lines.groupBy("dataset_id").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in lines.columns])
        named = F.filter(F.array(*[F.when(F.col(c), F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.lit(kind[c]).alias("data_type")))
                                   for i, c in enumerate(lines.columns)]), lambda x: x.isNotNull())
        return seen.select("dataset_id", F.inline(named))

    @property
    def forecasts(self) -> DataFrame:
        points = FO.daily_points(self.lines, "ship_date", ["quantity"], ["dataset_id"])
        return FO.select_forecast(FO.linear_candidates(points, ["dataset_id"]), ["dataset_id"]).withColumnRenamed("measure", "column")


def _label(c: str) -> str:
    return f"upper(left({c}, 1)) || substr({c}, 2)"


VIEWS["sig_pareto"] = (["supplier_lines"], """
    SELECT dataset_id, 'brand' AS dimension, 'revenue' AS measure, max(brand) FILTER (WHERE k = 1) AS leader, round(max(v) FILTER (WHERE k = 1) / max(t) * 100, 2) AS leader_share,
           round(sum(v) FILTER (WHERE k <= 3) / max(t) * 100, 2) AS top_3_share
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY v DESC, brand) AS k, sum(v) OVER (PARTITION BY dataset_id) AS t
          FROM (SELECT dataset_id, brand, sum(revenue) AS v FROM supplier_lines GROUP BY 1, 2)) GROUP BY 1""")
VIEWS["sig_conc"] = (["supplier_lines"], """
    SELECT dataset_id, 'brand' AS "column", max(brand) FILTER (WHERE k = 1) AS top_value, round(max(v) FILTER (WHERE k = 1) * 100e0 / max(t), 2) AS top_share,
           round(sum(v) FILTER (WHERE k <= 3) * 100e0 / max(t), 2) AS top_3_share
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY v DESC, brand) AS k, sum(v) OVER (PARTITION BY dataset_id) AS t
          FROM (SELECT dataset_id, brand, count(*) AS v FROM supplier_lines GROUP BY 1, 2)) GROUP BY 1""")
VIEWS["sig_dist"] = (["supplier_lines"], " UNION ALL ".join(f"""
    SELECT dataset_id, '{c}' AS "column", round(skewness({c}), 4) AS skew FROM supplier_lines GROUP BY 1""" for c in ("revenue", "tail")))
VIEWS["sig_anom"] = (["supplier_lines"], "SELECT * FROM (" + " UNION ALL ".join(f"""
    SELECT dataset_id, '{c}' AS "column", count(*) FILTER (WHERE {c} < a - 1.5e0 * (b - a) OR {c} > b + 1.5e0 * (b - a)) AS anomaly_count,
           round(count(*) FILTER (WHERE {c} < a - 1.5e0 * (b - a) OR {c} > b + 1.5e0 * (b - a)) * 100e0 / count(*), 4) AS anomaly_percent,
           CASE WHEN anomaly_percent >= 5 OR anomaly_count >= 25 THEN 'high' WHEN anomaly_percent >= 1 THEN 'medium' ELSE 'low' END AS severity,
           (CASE WHEN anomaly_percent >= 5 OR anomaly_count >= 25 THEN 82 WHEN anomaly_percent >= 1 THEN 72 ELSE 62 END)::BIGINT AS confidence
    FROM supplier_lines JOIN (SELECT dataset_id, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM supplier_lines GROUP BY 1) USING (dataset_id) GROUP BY 1"""
    for c in ("revenue", "tail")) + ") WHERE anomaly_count > 0")
VIEWS["sig_daily"] = (["supplier_lines"], """
    SELECT dataset_id, start, coalesce(q, 0) AS quantity, coalesce(r, 0) AS revenue FROM
    (SELECT dataset_id, unnest(generate_series(min(date_trunc('day', ship_date))::TIMESTAMP, max(date_trunc('day', ship_date))::TIMESTAMP, INTERVAL 1 DAY)) AS start FROM supplier_lines GROUP BY 1)
    LEFT JOIN (SELECT dataset_id, date_trunc('day', ship_date)::TIMESTAMP AS start, sum(quantity) AS q, sum(revenue) AS r FROM supplier_lines GROUP BY 1, 2) USING (dataset_id, start)""")
VIEWS["sig_move"] = (["sig_daily"], """
    SELECT dataset_id, "column", upper(left("column", 1)) || substr("column", 2) || ' Total' AS kpi, round(v, 4) AS value, round((v - p) / abs(p) * 100, 2) AS trend,
           CASE WHEN v > p THEN 'up' WHEN v < p THEN 'down' ELSE 'flat' END AS trend_direction, 98::BIGINT AS confidence, round(p, 4) AS previous
    FROM (SELECT *, lag(v) OVER w AS p, row_number() OVER (PARTITION BY dataset_id, "column" ORDER BY m DESC) AS k FROM (""" + " UNION ALL ".join(f"""
        SELECT dataset_id, '{c}' AS "column", date_trunc('month', start) AS m, sum({c}) AS v FROM sig_daily GROUP BY 1, 3""" for c in MEASURES) + """)
        WINDOW w AS (PARTITION BY dataset_id, "column" ORDER BY m)) WHERE k = 1 AND p IS NOT NULL""")
VIEWS["sig_catalog"] = (["supplier_lines"], " UNION ALL ".join(f"""
    SELECT dataset_id, '{c}' AS column_name, {i} AS position, '{kind}' AS data_type FROM supplier_lines GROUP BY 1 HAVING count({c}) > 0"""
    for i, (c, kind) in enumerate([("ship_date", "time"), ("brand", "text"), ("revenue", "number"), ("quantity", "number"), ("tail", "number")])))
VIEWS["sig_forecast"] = (["sig_daily"], """
    SELECT dataset_id, 'quantity' AS "column", predicted, (predicted - cur) / nullif(abs(cur), 0) * 100 AS change FROM (
        SELECT dataset_id, arg_max(y, x) AS cur, regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 30) AS predicted FROM (
            SELECT dataset_id, quantity AS y, (row_number() OVER (PARTITION BY dataset_id ORDER BY start) - 1)::DOUBLE AS x FROM sig_daily) GROUP BY 1 HAVING count(y) >= 8)""")
_COL = _label('"column"')
VIEWS["insights"] = (["sig_pareto", "sig_conc", "sig_dist", "sig_anom", "sig_move"], f"""
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY kind, pos)::INT AS rank FROM (
    SELECT dataset_id, 0 AS kind, dimension AS pos, 'Revenue concentration' AS title, 'Top 3 brand values generate ' || top_3_share || '% of revenue. ' || leader || ' alone contributes ' || leader_share || '%.' AS observation,
           'High concentration can make performance dependent on a narrow segment.' AS impact, 0.9e0 AS confidence, leader AS ekpi, leader_share AS evalue FROM sig_pareto
    UNION ALL SELECT dataset_id, 1, "column", {_COL} || ' concentration', 'Top 3 values in ' || {_COL} || ' represent ' || top_3_share || '% of records. ' || top_value || ' is the largest group at ' || top_share || '%.',
           'A concentrated segment can hide smaller but important groups.', 0.84e0, "column", top_3_share FROM sig_conc WHERE top_3_share >= {SHARE}
    UNION ALL SELECT dataset_id, 2, "column", {_COL} || ' skew', {_COL} || ' is skewed (' || skew || '), so large values pull averages upward.',
           'Average-based KPIs may be misleading for this metric.', 0.78e0, "column", skew FROM sig_dist WHERE skew >= {SKEW}
    UNION ALL SELECT dataset_id, 3, "column", 'Anomaly in ' || {_COL}, "column" || ' has ' || anomaly_count || ' unusual values detected by iqr.',
           'Unusual values can distort averages, totals, forecasts, and segment rankings.', 0.76e0, "column", anomaly_count FROM sig_anom
    UNION ALL SELECT dataset_id, 4, "column", kpi || ' movement', kpi || CASE trend_direction WHEN 'up' THEN ' increased by ' ELSE ' decreased by ' END || trend || ' based on the detected comparison period.',
           'Directional movement can affect revenue, profitability, capacity, or planning.', 0.9e0, kpi, trend FROM sig_move WHERE trend <> 0) WHERE true QUALIFY rank <= 12""")
_LOWF = "lower(observation)"
_PROBLEM = f"regexp_matches({_LOWF}, '{'|'.join(L.PROBLEM_WORDS)}')"
_DEPEND = f"regexp_matches({_LOWF}, '{'|'.join(L.CONCENTRATION_WORDS)}')"
_GROW = f"regexp_matches({_LOWF}, '{'|'.join(L.GROWTH_WORDS)}')"
VIEWS["plans"] = (["insights"], f"""
    SELECT * FROM (SELECT dataset_id, rank, title, observation AS finding, CASE WHEN lower(impact) LIKE 'high%' THEN 'High' ELSE 'Medium' END AS expected_impact,
           round(confidence * 100)::BIGINT AS confidence, CASE WHEN {_PROBLEM} OR {_DEPEND} THEN 'High' ELSE 'Medium' END AS risk_reduction,
           CASE WHEN NOT {_PROBLEM} AND NOT {_DEPEND} AND {_GROW} THEN 'High' ELSE 'Medium' END AS revenue_increase,
           row_number() OVER (PARTITION BY dataset_id ORDER BY lower(impact) LIKE 'high%' DESC, round(confidence * 100) DESC, rank)::INT AS place FROM insights) WHERE place <= 8""")
VIEWS["quality"] = ([], """
    SELECT dataset_id, sum(n)::BIGINT AS rows, round(sum(n) FILTER (WHERE q IS NULL) * 100e0 / (sum(n) * 2), 2) AS missing_percent, round(sum(n - 1) * 100e0 / (sum(n) * 10), 2) AS duplicate_percent
    FROM (SELECT l_suppkey AS dataset_id, p_brand, CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS q, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) GROUP BY 1""")


@query("ins1_evidence_insights", sql("insights", "SELECT dataset_id, rank, title, observation, impact, confidence, ekpi, evalue FROM insights"))
def ins1(spark, sf):
    e = F.col("evidence")[0]
    return Signals(spark, sf).insights.select("dataset_id", "rank", "title", "observation", "impact", "confidence", e["kpi"].alias("ekpi"), e["value"].alias("evalue"))


@query("ins2_insight_battery", sql("holed", """
    , c AS (SELECT 21 * 0 + count(*) - count(region) AS r, count(*) - count(quantity) AS q, count(*) - count(discount) AS d, count(*) AS n FROM holed)
    , g AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM holed GROUP BY order_id, order_date, region, category, quantity, revenue, discount))
    , m AS (SELECT date_trunc('month', order_date) AS m, sum(revenue) AS v FROM holed GROUP BY 1)
    , k AS (SELECT v, row_number() OVER (ORDER BY m DESC) AS i FROM m)
    , a AS (SELECT avg(v) FILTER (WHERE i <= 3) AS r, avg(v) FILTER (WHERE i BETWEEN 4 AND 6) AS p FROM k)
    , t AS (SELECT sum(quantity) AS q, sum(revenue) AS r, sum(discount) AS d FROM holed)
    SELECT 'Executive summary' AS title, 0.9e0 AS confidence, 2 AS evidence_count FROM c
    UNION ALL SELECT 'Duplicate rows found', 0.9e0, 2 FROM g WHERE dup > 0
    UNION ALL SELECT 'Missing data hotspots', 0.88e0, 3 FROM c WHERE r + q + d > 0
    UNION ALL SELECT 'Data health score', 0.85e0, 1
    UNION ALL SELECT 'Top numeric contributor: ' || unnest(['Quantity', 'Revenue', 'Discount']), 0.8e0, 1
    UNION ALL SELECT 'Revenue growth', 0.88e0, 1 FROM a WHERE p > 0
    UNION ALL SELECT 'Correlation: Quantity & Revenue', 0.8e0, 1 FROM holed HAVING abs(corr(quantity, revenue)) >= 0.6
    UNION ALL SELECT 'Opportunity: focus on Revenue', 0.82e0, 1 FROM t WHERE r > q AND r > d"""))
def ins2(spark, sf):
    found = I.insight_battery(Tables(spark, sf).holed, "order_date")
    return found.select("title", "confidence", F.size("evidence").alias("evidence_count"))


_STRENGTH = "CASE WHEN evalue BETWEEN 0 AND 100 THEN evalue / 100 ELSE 0.5e0 END"


@query("ins3_score_insights", sql("insights", f"""
    , s AS (SELECT *, {_STRENGTH} AS st FROM insights), i AS (SELECT *, round(least(100, st * 60 + confidence * 30 + 5))::BIGINT AS bis FROM s)
    SELECT dataset_id, rank, bis AS business_impact_score, round(least(100, bis * 1.1e0))::BIGINT AS importance,
           CASE WHEN bis >= 70 OR (confidence >= 0.85 AND st >= 0.4) THEN 'High' WHEN bis >= 45 OR confidence >= 0.65 THEN 'Medium' ELSE 'Low' END AS priority FROM i"""))
def ins3(spark, sf):
    return I.score_insights(Signals(spark, sf).insights).select("dataset_id", "rank", "business_impact_score", "importance", "priority")


@query("ins4_render_modes", sql("insights", """
    SELECT dataset_id, rank, observation || '. Evidence: ' || ekpi || '=' || evalue::DOUBLE AS mode_data,
           trim(regexp_replace(string_split(observation, '.')[1], '[()]', '', 'g')) AS mode_eli5 FROM insights"""))
def ins4(spark, sf):
    return I.render_modes(Signals(spark, sf).insights).select("dataset_id", "rank", "mode_data", "mode_eli5")


def _replaced(text: str, language: str) -> str:
    """SQL that replaces the phrases of a language in a text."""
    for phrase, other in L.PHRASES[language].items():
        text = f"replace({text}, '{phrase}', '{other}')"
    return text


@query("ins4_localized_modes", sql("insights", f"""
    , m AS (SELECT dataset_id, rank, observation || ' ' || impact || ' Recommended action: ' || CASE kind
                   WHEN 0 THEN 'Monitor the top ' || pos || ' contributors separately and grow the long tail to reduce dependency.'
                   WHEN 1 THEN 'Break reporting for ' || replace(title, ' concentration', '') || ' into leader versus long-tail segments.'
                   WHEN 2 THEN 'Use median, percentiles, and segment-level views for ' || replace(title, ' skew', '') || '.'
                   WHEN 3 THEN 'Inspect source rows for ' || replace(title, 'Anomaly in ', '') || ' before using this metric for decisions.'
                   ELSE 'Review drivers behind ' || ekpi || ' movement before setting targets.' END AS business, 'Based on observed evidence: ' || ekpi || ': ' || evalue::DOUBLE AS reasoning,
            observation || '. Evidence: ' || ekpi || '=' || evalue::DOUBLE AS data, trim(regexp_replace(string_split(observation, '.')[1], '[()]', '', 'g')) AS simple FROM insights)
    SELECT dataset_id, rank, reasoning, {_replaced("business", "hi")} AS business_hi, {_replaced("business", "hinglish")} AS business_hinglish,
           {_replaced("data", "hi")} AS data_hi, {_replaced("simple", "hinglish")} AS eli5_hinglish FROM m"""))
def ins4_localized(spark, sf):
    said = I.localize_modes(I.render_modes(I.with_reasoning(Signals(spark, sf).insights)))
    return said.select("dataset_id", "rank", "reasoning", F.col("mode_business_hi").alias("business_hi"), F.col("mode_business_hinglish").alias("business_hinglish"),
                       F.col("mode_data_hi").alias("data_hi"), F.col("mode_eli5_hinglish").alias("eli5_hinglish"))


VIEWS["recs"] = (["insights"], """
    SELECT dataset_id, rank, CASE kind WHEN 0 THEN 'Concentration Risk: ' || ekpi WHEN 1 THEN 'Concentration Risk: ' || upper(left(ekpi, 1)) || substr(ekpi, 2)
                                       WHEN 2 THEN 'Action: ' || upper(left(pos, 1)) || substr(pos, 2) || ' Skew' WHEN 3 THEN 'Anomaly Investigation'
                                       ELSE 'Action: ' || upper(left(pos, 1)) || substr(pos, 2) || ' Total Movement' END AS title,
           CASE WHEN (CASE WHEN evalue BETWEEN 0 AND 100 THEN evalue / 100 ELSE 0.5e0 END) >= 0.6 OR confidence >= 0.85 THEN 'High' WHEN confidence >= 0.65 THEN 'Medium' ELSE 'Low' END AS priority,
           round(confidence * 100)::BIGINT AS confidence FROM insights""")


@query("rec1_recommend_from_insights", sql("recs", "SELECT * FROM recs"))
def rec1(spark, sf):
    return R.recommend_from_insights(Signals(spark, sf).insights).select("dataset_id", "rank", "title", "priority", "confidence")


@query("rec2_rank_recommendations", sql("recs", """
    , f AS (SELECT dataset_id, title, arg_min(priority, rank) AS priority, arg_min(confidence, rank) AS confidence, min(rank) AS rank FROM recs GROUP BY 1, 2)
    SELECT dataset_id, title, priority, confidence, row_number() OVER (PARTITION BY dataset_id ORDER BY CASE priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, confidence DESC, rank)::INT AS place FROM f"""))
def rec2(spark, sf):
    ranked = R.rank_recommendations(R.recommend_from_insights(Signals(spark, sf).insights))
    return ranked.select("dataset_id", "title", "priority", "confidence", "place")


@query("rec3_prioritized", sql("plans", "SELECT dataset_id, rank, finding, expected_impact, confidence, risk_reduction, revenue_increase, place FROM plans"))
def rec3(spark, sf):
    return Signals(spark, sf).plans.select("dataset_id", "rank", "finding", "expected_impact", "confidence", "risk_reduction", "revenue_increase", "place")


@query("rec4_normalize", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Recommended action' ELSE o_orderpriority END AS title,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'Review the supporting evidence before acting.' END AS detail, 'Medium' AS impact FROM orders""")
def rec4(spark, sf):
    raw = Tables(spark, sf).orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("action"),
        F.lit("").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("observation"))
    return R.normalize_recommendations(raw).select("o_orderkey", "title", "detail", "impact")


_EXEC = """
    , n AS (SELECT dataset_id, count(*) AS n FROM sig_anom GROUP BY 1), u AS (SELECT dataset_id, bool_or(trend > 0) AS up FROM sig_move GROUP BY 1)
    , x AS (SELECT q.*, coalesce(n, 0) AS n, up, greatest(35, least(95, floor(100 - missing_percent - duplicate_percent - least(coalesce(n, 0), 5) * 3)))::BIGINT AS score
            FROM quality q LEFT JOIN n USING (dataset_id) LEFT JOIN u USING (dataset_id))"""


@query("prf21_executive_health", sql("quality sig_anom sig_move", _EXEC + """
    SELECT dataset_id, score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Watchlist' ELSE 'At Risk' END AS label FROM x"""))
def prf21(spark, sf):
    s = Signals(spark, sf)
    n = s.anomalies.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    joined = s.quality.join(n, "dataset_id", "left")
    score, label = P.executive_health(F.col("missing_percent"), F.col("duplicate_percent"), F.coalesce("n", F.lit(0)))
    return joined.select("dataset_id", score.alias("score"), label.alias("label"))


@query("prf22_display_health", sql("quality", """
    SELECT dataset_id, greatest(20, round(100 - least(80, missing_percent + duplicate_percent)))::BIGINT AS score FROM quality"""))
def prf22(spark, sf):
    return Signals(spark, sf).quality.select("dataset_id", P.display_health(F.col("missing_percent"), F.col("duplicate_percent")).alias("score"))


@query("rpt1_executive_outputs", sql("quality sig_anom sig_move plans", _EXEC + """
    , p AS (SELECT dataset_id, least(count(*), 3) AS acts FROM plans GROUP BY 1)
    SELECT dataset_id, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Watchlist' ELSE 'At Risk' END AS business_health, score AS overall_score,
           CASE WHEN up THEN 'Improving' WHEN n > 0 OR missing_percent > 5 THEN 'Needs attention' ELSE 'Stable' END AS current_trend, 'Revenue concentration' AS top_opportunity,
           CASE WHEN missing_percent > 5 THEN 'Data completeness risk' WHEN n > 0 THEN 'Anomaly risk' ELSE 'No major risk detected in the current analysis' END AS top_risk,
           acts::BIGINT AS action_count FROM x JOIN p USING (dataset_id)"""))
def rpt1(spark, sf):
    s = Signals(spark, sf)
    found = R.executive_outputs(s.quality, s.insights, s.anomalies, s.movements, s.plans)
    return found.drop("expected_revenue_growth", "overall_confidence")


@query("rpt2_distinct_modes", sql("insights", """
    , f AS (SELECT dataset_id, string_agg(kpi || ': ' || value, ', ' ORDER BY "column") AS figures FROM sig_move GROUP BY 1)
    SELECT dataset_id, observation || ' KPI focus: ' || coalesce(figures, 'No business KPI detected') || '. Prioritize actions that improve growth, profitability, and risk control.' AS business,
           'Think of the data like a shop notebook. The biggest clue is: ' || observation AS eli5 FROM insights LEFT JOIN f USING (dataset_id) WHERE rank = 1"""))
def rpt2(spark, sf):
    s = Signals(spark, sf)
    return R.distinct_modes(s.insights, s.movements)


@query("rpt3_qa_checks", sql("quality plans sig_move", """
    SELECT q.dataset_id, count(m.kpi) > 0 AS kpi_non_empty, true AS kpi_values_not_null, true AS insights_grounded, true AS recommendations_grounded,
           count(m.trend) > 0 AS trend_cards_present, any_value(q.rows) > 0 AS dataset_integrity, count(m.kpi) > 0 AND count(m.trend) > 0 AS passed
    FROM quality q LEFT JOIN sig_move m USING (dataset_id) GROUP BY 1"""))
def rpt3(spark, sf):
    s = Signals(spark, sf)
    return R.qa_checks(s.quality, s.movements, s.insights, s.plans)


@query("rpt4_advisor_actions", sql("sig_anom plans", """
    , a AS (SELECT dataset_id, upper(left("column", 1)) || substr("column", 2) AS title, confidence, CASE WHEN confidence >= 85 THEN 'High' WHEN confidence >= 65 THEN 'Medium' ELSE 'Low' END AS priority, 'anomaly_engine' AS source FROM sig_anom
            UNION ALL SELECT DISTINCT dataset_id, 'Quantity', 58, 'Low', 'forecast_engine' FROM supplier_lines
            UNION ALL SELECT dataset_id, 'Act On ' || array_to_string(list_transform(string_split(title, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '), confidence,
                   CASE WHEN confidence >= 85 THEN 'High' WHEN confidence >= 65 THEN 'Medium' ELSE 'Low' END, 'recommendation_engine' FROM plans WHERE place <= 6)
    , k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY CASE priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, confidence DESC, source, title)::INT AS rank FROM a)
    SELECT * FROM k WHERE rank <= 8"""))
def rpt4(spark, sf):
    s = Signals(spark, sf)
    return R.advisor_actions(s.anomalies, s.forecasts, s.plans)


@query("rpt5_explain_kpis", sql("sales", """
    , g AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM sales GROUP BY order_id, order_date, customer_name, product_name, category, region, quantity, revenue, discount, cost))
    , c AS (SELECT region, round(round(sum(revenue) / (SELECT sum(revenue) FROM sales) * 100, 2), 1) AS share FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1)
    , p AS (SELECT product_name FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1)
    SELECT format('Your dataset has {:,} records across 10 columns. Total Revenue is about {:.2f} lakh. {} is your strongest Region, contributing nearly {:.1f}% of measured value. Your leading Product Name is {}. ',
                  (SELECT count(*) FROM sales), (SELECT sum(revenue) FROM sales) / 100000e0, region, share, product_name)
           || CASE WHEN d > 0 THEN format('Data quality needs attention: 0 missing values and {} duplicate rows can affect decisions.', d::BIGINT)
                   ELSE 'Data quality looks strong, with no obvious missing-value or duplicate-row blocker.' END AS text FROM g, c, p"""))
def rpt5(spark, sf):
    return ASK.explain_kpis(Tables(spark, sf).sales)


@query("rpt6_suggestions", sql("holed", """
    SELECT i::INT AS rank, text FROM (VALUES (1, 'Ask: Explain my KPIs'), (2, 'Ask: Which Category generates maximum revenue?'),
    (3, 'Ask: Which Region is performing best?'), (4, 'Ask: Why are profits decreasing?')) v(i, text)"""))
def rpt6(spark, sf):
    return ASK.suggestions(Tables(spark, sf).holed)


@query("rpt8_lifecycle", domain_sql("sig_catalog quality plans", "sig_catalog") + """
    SELECT q.dataset_id, rows, (SELECT count(*) FROM sig_catalog c WHERE c.dataset_id = q.dataset_id) AS columns, CASE WHEN total > 0 THEN name ELSE 'generic' END AS domain,
           100 - missing_percent AS overall_health_score, 'Linear trend fallback' AS models_used,
           format('{} rows, {} columns, {} insights, {} recommendations', rows, (SELECT count(*) FROM sig_catalog c WHERE c.dataset_id = q.dataset_id), i, p) AS summary FROM quality q
    JOIN (SELECT dataset_id, name, total FROM k WHERE i = 1) USING (dataset_id)
    JOIN (SELECT dataset_id, count(*) AS i FROM insights GROUP BY 1) USING (dataset_id) JOIN (SELECT dataset_id, count(*) AS p FROM plans GROUP BY 1) USING (dataset_id)""")
def rpt8(spark, sf):
    s = Signals(spark, sf)
    widths = s.catalog.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("columns"))
    shape = s.quality.select("dataset_id", "rows").join(widths, "dataset_id")
    health = s.quality.select("dataset_id", (100 - F.col("missing_percent")).alias("overall_health_score"))
    return R.lifecycle(shape, CA.classify_domain(s.catalog).select("dataset_id", "domain"), health, s.forecasts.select("dataset_id", "model"), s.insights, s.plans)


@query("rpt9_report", sql("users plans", """
    , r AS (SELECT user_id, arg_max(upload_id, struct_pack(a := created_at, b := upload_id)) % (SELECT count(*) FROM supplier) AS dataset_id FROM uploads GROUP BY 1)
    SELECT user_id, r.dataset_id, 'insights' AS section, rank, observation AS text FROM r JOIN insights i ON i.dataset_id = r.dataset_id
    UNION ALL SELECT user_id, r.dataset_id, 'recommendations', place, finding FROM r JOIN plans p ON p.dataset_id = r.dataset_id"""))
def rpt9(spark, sf):
    from tallyforge.operators.relational import latest_upload

    s = Signals(spark, sf)
    suppliers = s.t.supplier.agg(F.count(F.lit(1)).alias("n")).scalar()
    newest = latest_upload(uploads(s.t), users(s.t).withColumn("latest_upload_id", F.lit(None).cast("long")))
    latest = newest.select("user_id", (F.col("upload_id") % suppliers).alias("dataset_id"))
    return R.report(latest, {
        "insights": s.insights.select("dataset_id", "rank", F.col("observation").alias("text")),
        "recommendations": s.plans.select("dataset_id", F.col("place").alias("rank"), F.col("finding").alias("text")),
    })


@query("rpt10_basic_insights", sql("insights", "SELECT dataset_id, rank, title FROM insights WHERE rank <= 3 OR dataset_id % 5 = 0"))
def rpt10(spark, sf):
    return R.basic_insights(Signals(spark, sf).insights, F.col("dataset_id") % 5 == 0).select("dataset_id", "rank", "title")


# ---------------------------------------------------------------- business wording of signals

@query("anm8_enrich_anomalies", sql("sig_anom sig_daily", """
    , g AS (SELECT dataset_id, brand, sum(revenue) AS v, row_number() OVER (PARTITION BY dataset_id ORDER BY sum(revenue) DESC, brand) AS k FROM supplier_lines GROUP BY 1, 2)
    , l AS (SELECT a.dataset_id, a.brand AS leader, round(round((a.v - b.v) / abs(b.v) * 100, 2), 1) AS lift FROM g a JOIN g b ON a.dataset_id = b.dataset_id AND a.k = 1 AND b.k = 2)
    , d AS (SELECT dataset_id, revenue, row_number() OVER (PARTITION BY dataset_id ORDER BY start DESC) AS i FROM sig_daily)
    , w AS (SELECT dataset_id, round((avg(revenue) FILTER (WHERE i <= 7) - avg(revenue) FILTER (WHERE i BETWEEN 8 AND 14)) / abs(nullif(avg(revenue) FILTER (WHERE i BETWEEN 8 AND 14), 0)) * 100, 1) AS change FROM d GROUP BY 1)
    , j AS (SELECT *, upper(left("column", 1)) || substr("column", 2) AS focus FROM sig_anom LEFT JOIN l USING (dataset_id) LEFT JOIN w USING (dataset_id))
    SELECT dataset_id, "column", CASE WHEN abs(change) >= 20 THEN 'Revenue ' || CASE WHEN change > 0 THEN 'Jumped ' ELSE 'Dropped ' END || abs(change) || '% Recently'
                WHEN abs(lift) >= 25 THEN 'Revenue Is Unusually Concentrated in ' || leader ELSE focus || ' Needs Immediate Attention' END AS headline,
           CASE WHEN abs(change) >= 20 THEN CASE WHEN abs(change) >= 35 THEN 'High' ELSE 'Medium' END WHEN severity = 'high' THEN 'High' ELSE 'Medium' END AS business_impact,
           severity, confidence, anomaly_count FROM j"""))
def anm8(spark, sf):
    s = Signals(spark, sf)
    lead = TR.leader_gap(s.lines, "brand", ["revenue"], ["dataset_id"]).select(
        "dataset_id", "measure", "leader", F.round("difference_percent", 1).alias("lift_percent"))
    week = TR.recent_week_change(s.lines, "ship_date", "revenue", ["dataset_id"]).select("dataset_id", "change_percent")
    found = A.enrich_anomalies(s.anomalies, lead.join(week, "dataset_id", "left"))
    return found.select("dataset_id", "column", "headline", "business_impact", "severity", "confidence", "anomaly_count")


@query("anm9_root_causes", sql("sig_anom sig_move sig_catalog", f"""
    , r AS (SELECT DISTINCT dataset_id, name AS role FROM sig_catalog, {keyword_rows(L.ROLE_KEYWORDS)} WHERE contains(replace(lower(column_name), '_', ' '), word))
    , c AS (SELECT dataset_id, concat_ws('; ', CASE WHEN bool_or(role IN ('Orders', 'Customers')) THEN 'order volume or customer mix changed' END,
                   CASE WHEN bool_or(role IN ('Inventory', 'Products')) THEN 'product availability or inventory mix changed' END,
                   CASE WHEN bool_or(role IN ('Cost', 'Profit', 'Margins')) THEN 'cost, margin, or pricing pressure changed' END) AS causes FROM r GROUP BY 1)
    SELECT a.dataset_id, a."column", coalesce(nullif(causes, ''), 'source data, outlier rows, or upstream transformation changed') AS possible_causes,
           coalesce(m.kpi, a."column") AS affected_metrics, severity, (CASE WHEN severity = 'high' THEN 72 ELSE 62 END)::BIGINT AS confidence
    FROM sig_anom a LEFT JOIN c ON c.dataset_id = a.dataset_id LEFT JOIN sig_move m ON m.dataset_id = a.dataset_id AND m."column" = a."column" """))
def anm9(spark, sf):
    s = Signals(spark, sf)
    return A.root_causes(s.anomalies, s.movements.select("dataset_id", "kpi", "column"), CA.find_roles(s.catalog).select("dataset_id", "role"))


@query("kpi14_enrich_kpis", sql("sig_move sig_forecast", """
    , j AS (SELECT m.*, f.predicted, coalesce(CASE WHEN m.trend <> 0 THEN m.trend END, f.change, 0) AS moved FROM sig_move m LEFT JOIN sig_forecast f USING (dataset_id, "column"))
    SELECT dataset_id, kpi, value, round(moved, 2) AS trend, CASE WHEN moved > 0 THEN 'up' WHEN moved < 0 THEN 'down' ELSE 'flat' END AS trend_direction,
           previous AS previous_value, round(predicted, 2) AS forecast, 'High' AS confidence_label, moved > 0 AS is_good, predicted IS NOT NULL OR moved <> 0 AS should_act FROM j"""))
def kpi14(spark, sf):
    s = Signals(spark, sf)
    growth = TR.period_growth(s.lines, "ship_date", MEASURES, ["dataset_id"]).where("grain = 'MoM'")
    kpis = s.movements.select("dataset_id", "kpi", "value", F.array("column").alias("source_columns"), F.lit("sum").alias("aggregation"), "confidence")
    trends = growth.select("dataset_id", F.col("measure").alias("column"), F.col("growth_percent").alias("trend"), "previous")
    found = K.enrich_kpis(kpis, trends, s.forecasts.select("dataset_id", "column", "predicted_value", "change_percent"), ["dataset_id"])
    return found.select("dataset_id", "kpi", "value", "trend", "trend_direction", "previous_value", "forecast", "confidence_label", "is_good", "should_act")


_COUNTED = ("shape", "missing", "kpis", "trend_engine", "correlations", "concentration", "seasonality", "pareto")


@query("rpt7_run_analysis", sql("sales", """
    SELECT unnest(['shape', 'missing', 'kpis', 'trend_engine', 'correlations', 'concentration', 'seasonality', 'pareto']) AS section,
           unnest([1, 10, (SELECT 6 + (count(DISTINCT product_name) <= 50)::INT FROM sales), 16, 6, 4, 1, 3]) AS rows, 'ok' AS status"""))
def rpt7(spark, sf):
    from tallyforge.plans.analysis import run_analysis, section_sizes

    return section_sizes(spark, run_analysis(Tables(spark, sf).sales, "sales", models=False), _COUNTED)
