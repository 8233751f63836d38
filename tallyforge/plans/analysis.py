"""The whole battery over one table: every section as a DataFrame, every stage with a status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import NUMERIC_TYPES, TIME_TYPES, numeric_columns, text_columns
from tallyforge.operators import (
    anomaly as A, backbone as B, catalog as CA, charts as CH, forecast as FO, grouped as G, insight as I, kpi as K, models as MO,
    multivariate as M, normalize as N, profile as P, report as R, trend as TR,
)
from tallyforge.session import checkpoint_frame, staged_table


@dataclass
class Analysis:
    """Sections by name, and 'ok' or the error of every stage."""

    dataset_id: str
    sections: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, build: Callable[[], DataFrame]) -> None:
        """Compute a section; its rows (few, as all sections are aggregates) are kept in the checkpoint folder."""
        try:
            self.sections[name] = checkpoint_frame(build())
            self.status[name] = "ok"
        except Exception as exc:  # one failed stage must not hide the others
            self.status[name] = f"failed: {exc}"


def run_analysis(
    df: DataFrame, dataset_id: str, order_by: list[str] | None = None, key: str | None = None, models: bool = True,
    infer_types: bool = False,
) -> Analysis:
    """Profile, quality, key figures, trends, anomalies, forecasts, insights and advice for ``df``.

    All rows are used. The table is written once as Parquet because some thirty sections read columns of
    it, and what they share (statistics, quartiles, counts of values and of repeated rows, sums by day) is computed once; a section is computed when it is added, so its status tells how it ended. ``order_by`` (default: the time
    column) orders rows for sudden moves, with a hash of the row for ties; ``key`` names rows for the model-based detectors. Without
    ``models`` the forecasts to choose from, segments, drivers, detectors and the sections that put signals into words are left out.
    """
    repeated: list[str] = []
    if infer_types:
        df, report = N.normalize(df)
        repeated = report["duplicate_columns"]
    data = B.remember(staged_table(df))
    out = Analysis(dataset_id)
    numbers = [c for c in numeric_columns(data) if not P.is_id_name(c)]
    texts = text_columns(data)
    time, measure, dimension = K.choose_time(data), K.choose_measure(data), K.choose_dimension(data)

    out.add("shape", lambda: P.shape(data))
    out.add("missing", lambda: P.missing_by_column(data))
    out.add("validation", lambda: P.validation_report(data, repeated))
    out.add("schema", lambda: P.infer_semantic_schema(data))
    out.add("dataset_profile", lambda: P.inspect_dataset(data))
    out.add("domain", lambda: CA.classify_domain(CA.catalog_of(data, dataset_id)))
    out.add("kpis", lambda: K.dynamic_kpis(data))
    out.add("discovered_kpis", lambda: K.discovered_kpis(data, time))
    out.add("business_kpis", lambda: K.business_kpis(data))
    if numbers:
        out.add("distributions", lambda: P.distribution(data, numbers))
        out.add("outliers", lambda: P.outlier_counts(data, numbers))
        out.add("health", lambda: P.dataset_health(data, numbers))
        out.add("histogram", lambda: CH.histogram(data, numbers))
        out.add("box", lambda: CH.box(data, numbers))
    if len(numbers) > 1:
        out.add("correlations", lambda: G.correlation_pairs(data, numbers))
        out.add("scatter", lambda: CH.scatter_density(data, numbers[0], numbers[1]))
        out.add("row_zscore", lambda: A.row_zscore(data, numbers))
    if texts:
        out.add("concentration", lambda: G.concentration(data, texts))
        out.add("bar", lambda: CH.bar(data, texts))
    if measure and dimension:
        out.add("pareto", lambda: G.pareto(data, dimension, measure))
    if time and numbers:
        out.add("trend_engine", lambda: TR.period_growth(data, time, numbers))
        out.add("trend_cards", lambda: TR.trend_cards(data, numbers, time))
        out.add("linear_trend", lambda: TR.linear_trend(data, time, numbers))
        out.add("anomalies", lambda: A.rule_anomalies(*_ordered(data, order_by or [time]), numbers, table=data))
        out.add("seasonality", lambda: TR.seasonality(data, time, measure))
        out.add("forecast", lambda: FO.forecast(data, time, numbers))
        out.add("line", lambda: CH.line(data, time, numbers))
        if models:
            out.add("forecast_selection", lambda: FO.select_forecast(FO.forecast_candidates(FO.daily_points(data, time, numbers))))
        customer = next(iter(K.roles_of(data.columns)["Customers"]), None)
        if customer:
            out.add("cohorts", lambda: TR.cohorts(data, customer, time))
    if models and len(numbers) > 1:
        out.add("segments", lambda: MO.segment_profile(MO.kmeans_segments(data, numbers)[0], numbers))
        out.add("drivers", lambda: MO.driver_importance(data, numbers))
        if key:
            out.add("isolation_forest", lambda: M.summarize(data, key, numbers, M.isolation_forest(data, key, numbers), "Isolation Forest"))
            out.add("local_outlier_factor", lambda: M.summarize(
                data, key, numbers, M.local_outlier_factor(data, key, numbers).where("lof > 1.5"), "Local Outlier Factor"))
            out.add("density_noise", lambda: M.summarize(data, key, numbers, M.density_noise(data, key, numbers), "DBSCAN"))
    if models and numbers and time:
        _evidence(out, data, numbers, time, measure, dimension)
    out.add("insights", lambda: _ranked(I.insight_battery(data, time, dataset_id)))
    if "insights" in out.sections:
        scored = I.score_insights(out.sections["insights"])
        out.add("scored_insights", lambda: I.localize_modes(I.render_modes(I.with_reasoning(scored))))
        out.add("recommendations", lambda: R.rank_recommendations(R.recommend_from_insights(out.sections["insights"])))
        out.add("action_plan", lambda: R.prioritized(out.sections["insights"]))
    return out


def _evidence(out: Analysis, data: DataFrame, numbers: list[str], time: str, measure: str, dimension: str | None) -> None:
    """The sections that put signals into words: evidence, enriched figures and anomalies, causes, executive outputs.

    Signals are small tables, computed once as sections; where one failed, the sections that need it fail and say so.
    """
    id_ = I.KEY
    lines = data.drop(id_).withColumn(id_, F.lit(out.dataset_id))
    part = out.sections
    if dimension:
        out.add("pareto_signal", lambda: I.pareto_signal(lines, dimension, measure))
        out.add("concentration_signal", lambda: I.concentration_signal(lines, dimension))
    out.add("distribution_signal", lambda: B.numeric_stats(lines, numbers, [id_]).select(id_, "column", F.round("skew", 4).alias("skew")))
    out.add("anomaly_signal", lambda: I.anomaly_signal(lines, numbers))
    out.add("movement_signal", lambda: I.movement_signal(lines, time, numbers))
    if dimension:
        out.add("evidence_insights", lambda: I.evidence_insights(*(part[f"{k}_signal"] for k in ("pareto", "concentration", "distribution", "anomaly", "movement"))))
        out.add("enriched_anomalies", lambda: A.enrich_anomalies(part["anomaly_signal"], TR.leader_gap(lines, dimension, [measure], [id_]).select(
            id_, "measure", "leader", F.round("difference_percent", 1).alias("lift_percent")).join(
                TR.recent_week_change(lines, time, measure, [id_]).select(id_, "change_percent"), id_, "left")))
    roles = [(out.dataset_id, role) for role, columns in K.roles_of(data.columns).items() if columns]
    spark = data.sparkSession
    if "business_kpis" in part:
        counted = F.col("kpi").isin(*L.DISTINCT_ROLES)  # figures named by their role count its distinct values
        figures = part["business_kpis"].withColumn(id_, F.lit(out.dataset_id)).withColumn("aggregation", F.when(counted, "nunique").otherwise("sum"))
        out.add("enriched_kpis", lambda: K.enrich_kpis(
            figures, part["trend_engine"].where("grain = 'MoM'").select(F.lit(out.dataset_id).alias(id_), F.col("measure").alias("column"), F.col("growth_percent").alias("trend"), "previous"),
            (part["forecast_selection"] if "forecast_selection" in part else FO.select_forecast(FO.linear_candidates(FO.daily_points(data, time, numbers)))).select(
                F.lit(out.dataset_id).alias(id_), F.col("measure").alias("column"), "predicted_value", "change_percent"), [id_]))
        out.add("root_causes", lambda: A.root_causes(
            part["anomaly_signal"], figures.select(id_, "kpi", F.explode("source_columns").alias("column")), spark.createDataFrame(roles, f"{id_} string, role string")))
    if "evidence_insights" in part:
        out.add("executive_outputs", lambda: R.executive_outputs(
            P.dataset_health(data, numbers).select(F.lit(out.dataset_id).alias(id_), "missing_percent", "duplicate_percent"),
            part["evidence_insights"], part["anomaly_signal"], part["movement_signal"], R.prioritized(part["evidence_insights"])))


def _ordered(data: DataFrame, order_by: list[str]) -> tuple[DataFrame, list[str], Column]:
    """The table with a hash of the row as last tie breaker, its total order, and buckets that rise with the first order column."""
    first = data.schema[order_by[0]].dataType
    keyed = data.withColumn("_tie", F.xxhash64(*data.columns))
    name = F.col(f"`{order_by[0]}`")
    if isinstance(first, TIME_TYPES):
        bucket = F.to_date(name)
    else:
        # about a thousand ranges between quantiles of the column
        cuts = data.agg(F.percentile_approx(name.cast("double"), [k / 1000 for k in range(1, 1000)], 10_000).alias("c")).first()["c"] \
            if isinstance(first, NUMERIC_TYPES) else None
        bucket = F.width_bucket(name.cast("double"), F.lit(float(cuts[0])), F.lit(float(cuts[-1])), F.lit(1000)) if cuts and cuts[0] < cuts[-1] else F.lit(0)
    return keyed, [*order_by, "_tie"], bucket


def _ranked(battery: DataFrame) -> DataFrame:
    """The battery of one table (some dozens of rows) with its rank."""
    rank = F.row_number().over(W.partitionBy("dataset_id").orderBy("section", "title"))
    return battery.withColumn("rank", rank).drop("section")


def section_sizes(spark: SparkSession, result: Analysis, names: tuple[str, ...] | None = None) -> DataFrame:
    """(section, rows, status) of every section that was tried (or of ``names``); rows are NULL where a section failed."""
    rows = [(n, result.sections[n].count() if n in result.sections else None, result.status.get(n, "not tried")) for n in names or result.status]
    return spark.createDataFrame(rows, "section string, rows int, status string")
