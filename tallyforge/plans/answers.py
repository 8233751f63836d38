"""Answers to many plans at once: a few shared tables for all asked columns instead of an aggregation per plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.quantile import exact_quantiles
from tallyforge.functions.semantics import col, growth, percent, ratio
from tallyforge.functions.text import humanize_name
from tallyforge.operators import backbone as B, profile as P
from tallyforge.session import checkpoint_frame, staged_table

KEYS = ["intent", "dimension", "measure", "n"]
ANSWER = ["answer_type", "label", "value", "share", "text"]
GROUPED = ["unique_count", "weakest", "leader", "advice"]
RANKED = ["top_n", "top_count", "most_common"]
NUMERIC = ["highest_value", "average", "outliers"]
WHOLE = ["rows", "columns", "quality", "unknown"]
_NEEDS_DIMENSION = ["weakest", "top_n", "top_count", "leader", "most_common", "advice"]
_NEEDS_MEASURE = ["top_n", "leader", *NUMERIC]
_MOST = 25


def answer_plans(df: DataFrame, plans: DataFrame, time: str | None, whole: dict) -> DataFrame:
    """(intent, dimension, measure, n, answer columns) for every distinct plan.

    ``whole`` builds the answers that need no column. Only the names of asked columns reach the driver. Sums of all asked pairs come from
    one aggregation, numbers of all measures from one, changes of all measures from one. A plan that lacks a column it needs, or of
    an unknown intent, is answered as unknown; a plan without data to answer it (no group, too few rows) has no row.
    """
    known = [*GROUPED, *RANKED, *NUMERIC, *WHOLE, "why_change"]
    lacks = (F.col("intent").isin(_NEEDS_DIMENSION) & F.col("dimension").isNull()) | (F.col("intent").isin(_NEEDS_MEASURE) & F.col("measure").isNull())
    kind = F.when(lacks | ~F.col("intent").isin(known), "unknown").otherwise(F.col("intent"))
    titles = F.create_map(*[F.lit(x) for c in df.columns for x in (c, humanize_name(c))])
    plans = checkpoint_frame(plans.select(*KEYS).distinct().select(
        *KEYS, kind.alias("kind"), titles[F.col("dimension")].alias("d"), titles[F.col("measure")].alias("m")))
    asked = plans.select("kind", "dimension", "measure").distinct().collect()  # at most intents x columns x columns

    def names(kinds: list[str], field: str) -> list[str]:
        return sorted({r[field] for r in asked if r["kind"] in kinds and r[field] is not None})

    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = []
    dims = names([*GROUPED, *RANKED], "dimension")
    if dims:
        cells = staged_table(_cells(df, dims, names([*GROUPED, *RANKED], "measure")))
        parts += [_grouped(plans, cells, rows), _ranked(plans, cells, rows)]
    measures = names(NUMERIC, "measure")
    if measures:
        parts.append(_numeric(df, plans, measures, names(["outliers"], "measure"), rows))
    moved = names(["why_change"], "measure")
    if moved and time:
        parts.append(_changes(df, plans, time, moved, names(["why_change"], "dimension")))
    for k in WHOLE:
        if any(r["kind"] == k for r in asked):
            one = whole[k]().select(F.lit(k).alias("kind"), *ANSWER)
            parts.append(plans.join(one, "kind").select(*KEYS, *ANSWER))
    nothing = plans.where(F.lit(False)).select(*KEYS, F.lit("").alias("answer_type"), F.lit("").alias("label"), F.lit(0.0).alias("value"), F.lit(0.0).alias("share"), F.lit("").alias("text"))
    return checkpoint_frame(reduce(DataFrame.unionByName, parts, nothing))


def _cells(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """(dimension, label, measure, amount): sums per value of every dimension, and under a null measure the number of rows."""
    values = _by_value(df, dims, [col(m).alias(f"_m{i}") for i, m in enumerate(measures)]).where("label IS NOT NULL")
    amounts = [F.struct(F.lit(None).cast("string").alias("measure"), F.count(F.lit(1)).cast("double").alias("amount"))]
    amounts += [F.struct(F.lit(m).alias("measure"), F.sum(f"_m{i}").cast("double").alias("amount")) for i, m in enumerate(measures)]
    sums = values.groupBy("at", "label").agg(F.array(*amounts).alias("s"))
    return sums.select(_named(dims), "label", F.inline("s")).where("amount IS NOT NULL")


def _by_value(df: DataFrame, dims: list[str], carried: list[Column], whole: bool = False) -> DataFrame:
    """(at, label, carried...): every row once per dimension, named by its place in ``dims``; with ``whole`` once more under place -1.

    A task keeps one entry per (place, label) while it adds up, so all figures of a label belong into that one entry.
    """
    places = [F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("label"))] if whole else []
    places += [F.struct(F.lit(i).alias("at"), col(d).cast("string").alias("label")) for i, d in enumerate(dims)]
    return df.select(F.inline(F.array(*places)), *carried)


def _named(dims: list[str]) -> Column:
    """The dimension at a place; NULL at -1."""
    return F.get(F.array(*[F.lit(d) for d in dims]).cast("array<string>"), F.col("at")).alias("dimension")


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[l].eqNullSafe(b[r]) for l, r in pairs])


def _plans_of(plans: DataFrame, kinds: list[str]) -> DataFrame:
    """Plans of some kinds and ``over``: the measure that their groups are measured by (null: rows)."""
    counted = F.when(~F.col("kind").isin("unique_count", "top_count", "most_common"), F.col("measure"))
    return plans.where(F.col("kind").isin(kinds)).withColumn("over", counted)


def _grouped(plans: DataFrame, cells: DataFrame, rows: Column) -> DataFrame:
    """Distinct values, the weakest and the leading group of every asked pair."""
    cents = F.round("amount", 2)
    facts = cells.groupBy(F.col("dimension").alias("_d"), F.col("measure").alias("_m")).agg(
        F.min(F.struct((-cents).alias("k"), "label", "amount")).alias("best"), F.min(F.struct("amount", "label")).alias("low"),
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("labels"))
    own = _plans_of(plans, GROUPED)
    met = own.join(facts, _same(own, facts, ("dimension", "_d"), ("over", "_m")), "left").withColumn("rows", rows)
    unique, weak, counted = F.col("kind") == "unique_count", F.col("kind") == "weakest", F.col("over").isNull()
    met = met.where(unique | F.col("best").isNotNull()).withColumn("amount", F.round(F.when(weak, F.col("low.amount")).otherwise(F.col("best.amount")), 2))
    met = met.withColumn("label", F.when(unique, F.col("dimension")).when(weak, F.col("low.label")).otherwise(F.col("best.label")))
    met = met.withColumn("share", F.when(unique, F.lit(None)).when(weak, F.round(ratio(F.col("low.amount"), F.when(counted, F.col("rows")).otherwise(F.col("total"))) * 100, 1))
                         .when(counted, percent(F.col("amount"), F.col("rows"), 1)).otherwise(F.round(F.round(ratio(F.col("best.amount"), F.col("total")) * 100, 2), 1)))
    met = met.withColumn("value", F.when(unique, F.coalesce("labels", F.lit(0)).cast("double")).otherwise(F.col("amount")))
    text = (
        F.when(unique, F.format_string("Your dataset has %,d unique values based on %s.", F.col("value").cast("long"), "d"))
        .when(weak, F.format_string("The weakest %s is '%s' with %.2f, only %.1f%% of the total.", F.replace(F.lower("dimension"), F.lit("_"), F.lit(" ")), "label", "amount", "share"))
        .when(F.col("kind") == "leader", F.format_string(
            "The leading %s by total %s is '%s'. It contributes %.2f, representing %.1f%% of the measured total.", "d", "m", "label", "amount", "share"))
        .when(counted, F.format_string("%s: %d rows (%.1f%%)", "label", F.col("amount").cast("long"), "share"))
        .otherwise(F.format_string("Suggestion: focus first on '%s' in %s because it contributes %.2f, about %.1f%% of the measured %s.", "label", "d", "amount", "share", "m"))
    )
    return met.select(*KEYS, F.col("kind").alias("answer_type"), "label", "value", "share", text.alias("text"))


def _ranked(plans: DataFrame, cells: DataFrame, rows: Column) -> DataFrame:
    """The n largest groups of every asked pair; ranks above 25 never leave the tasks that hold them."""
    order = W.partitionBy("dimension", "measure").orderBy(F.desc("amount"), F.asc("label"))
    best = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _MOST).select(
        F.col("dimension").alias("_d"), F.col("measure").alias("_m"), "label", "amount", "rank")
    own = _plans_of(plans, RANKED).withColumn("most", F.when(F.col("kind") == "most_common", 1).otherwise(F.greatest(F.lit(1), F.least(F.col("n"), F.lit(_MOST)))))
    met = own.join(best, _same(own, best, ("dimension", "_d"), ("over", "_m")) & (F.col("rank") <= F.col("most"))).withColumn("rows", rows)
    top = F.col("kind") == "top_n"
    total = F.sum("amount").over(W.partitionBy(*KEYS))  # of the at most 25 rows of a plan
    met = met.withColumn("share", F.when(top, F.round(ratio(F.col("amount"), total) * 100, 1)).otherwise(percent(F.col("amount"), F.col("rows"), 1)))
    text = F.when(top, F.format_string("%d. %s: %.2f (%.1f%% of the top total)", "rank", "label", F.round("amount", 2), "share")).otherwise(
        F.format_string("%s: %d rows (%.1f%%)", "label", F.col("amount").cast("long"), "share"))
    return met.select(*KEYS, F.col("kind").alias("answer_type"), "label", F.round("amount", 2).alias("value"), "share", text.alias("text"))


def _numeric(df: DataFrame, plans: DataFrame, measures: list[str], tested: list[str], rows: Column) -> DataFrame:
    """Largest value, mean with median, and outliers of every asked measure."""
    facts = B.numeric_summary(df, measures).select(F.col("column").alias("_m"), "max", F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"))
    if tested:
        facts = facts.join(P.outlier_counts(df, tested).select(F.col("column").alias("_m"), "outliers"), "_m", "left")
    else:
        facts = facts.withColumn("outliers", F.lit(0).cast("long"))
    own = _plans_of(plans, NUMERIC)
    met = own.join(facts, own["measure"] == facts["_m"]).withColumn("outliers", F.coalesce("outliers", F.lit(0))).withColumn("rows", rows)
    top, mean = F.col("kind") == "highest_value", F.col("kind") == "average"
    met = met.withColumn("value", F.when(top, F.col("max")).when(mean, F.col("mean")).otherwise(F.col("outliers").cast("double")))
    met = met.withColumn("share", F.when(mean, F.col("median")).when(~top, percent(F.col("outliers"), F.col("rows"), 1)))
    text = (
        F.when(top, F.format_string("The highest value is %.2f in %s.", "value", "m"))
        .when(mean, F.format_string("The average value for %s is %.2f, while the median is %.2f.", "m", "value", "share"))
        .when(F.col("outliers") > 0, F.format_string("Found %d outliers in %s (%.1f%% of rows).", "outliers", "m", "share"))
        .otherwise(F.format_string("No significant outliers detected in %s.", "m"))
    )
    return met.select(*KEYS, F.col("kind").alias("answer_type"), F.col("measure").alias("label"), "value", "share", text.alias("text"))


def _changes(df: DataFrame, plans: DataFrame, time: str, measures: list[str], dims: list[str], least: int = 4) -> DataFrame:
    """Change of every asked measure between the halves of its rows by time, and the segment of every asked dimension that drove it."""
    stamp = F.unix_micros(col(time).cast("timestamp")).cast("double")
    timed = df.where(col(time).isNotNull())
    # the times of a measure are a column, not a group, so no task gathers the rows of a measure
    times = timed.select(*[F.when(col(m).cast("double").isNotNull(), stamp).alias(f"_t{i}") for i, m in enumerate(measures)])
    mids = exact_quantiles(times, times.columns, [0.5])
    # one row: the middle of every asked measure
    mid = checkpoint_frame(mids.agg(*[F.max(F.when(F.col("column") == t, F.col("q")[0])).alias(f"_mid{i}") for i, t in enumerate(times.columns)]))
    values = [v for i, m in enumerate(measures) for v in (col(m).cast("double").alias(f"_v{i}"), (stamp > F.col(f"_mid{i}")).alias(f"_late{i}"))]
    halves = _by_value(timed.crossJoin(F.broadcast(mid)), dims, values, whole=True).where("at < 0 OR label IS NOT NULL")
    sides = [F.struct(F.lit(m).alias("measure"), F.count(f"_v{i}").alias("rows"),
                      *[F.coalesce(F.sum(F.when(side, F.col(f"_v{i}"))), F.lit(0.0)).alias(n) for n, side in (("previous", ~F.col(f"_late{i}")), ("recent", F.col(f"_late{i}")))])
             for i, m in enumerate(measures)]
    sums = halves.groupBy("at", "label").agg(F.array(*sides).alias("s")).select(_named(dims), "label", F.inline("s")).where("rows > 0")
    sums = staged_table(sums)
    change = growth(F.col("recent"), F.col("previous"), 1)
    whole = sums.where(F.col("dimension").isNull() & (F.col("rows") >= least) & (F.col("previous") != 0)).select(F.col("measure").alias("_m"), change.alias("change"))
    delta = F.col("recent") - F.col("previous")
    drivers = sums.where("dimension IS NOT NULL").groupBy(F.col("measure").alias("_m2"), F.col("dimension").alias("_d")).agg(
        F.sum(delta).alias("total"), F.min(F.struct(delta.alias("d"), "label")).alias("down"), F.min(F.struct((-delta).alias("d"), "label")).alias("up"))
    own = _plans_of(plans, ["why_change"])
    met = own.join(whole, own["measure"] == whole["_m"])
    met = met.join(drivers, (met["measure"] == drivers["_m2"]) & (met["dimension"] == drivers["_d"]), "left")
    met = met.withColumn("label", F.when(F.col("total") < 0, F.col("down.label")).otherwise(F.col("up.label")))
    text = F.concat(
        F.col("m"), F.when(F.col("change") < 0, " dropped").otherwise(" increased"), F.lit(" by "), F.abs("change").cast("string"),
        F.lit("% between the earlier and later periods."),
        F.coalesce(F.concat(F.lit(" The biggest segment driver was '"), F.col("label"), F.lit("'.")), F.lit("")))
    return met.select(*KEYS, F.col("kind").alias("answer_type"), "label", F.col("change").alias("value"), F.lit(None).cast("double").alias("share"), text.alias("text"))
