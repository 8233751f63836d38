"""Time series, growth, seasonality and change between periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.ordered import bucketed_previous
from tallyforge.functions.quantile import exact_median_time
from tallyforge.functions.semantics import col, direction, epoch_seconds, first_rows, growth, ratio
from tallyforge.operators import backbone as B

LABELS = {"W": "WoW", "M": "MoM", "Q": "QoQ", "Y": "YoY"}


def resample_sum(df: DataFrame, time: str, measures: list[str], grain: str, by: list[str] = ()) -> DataFrame:
    """(by..., period, measures...) with 0 for empty periods; a week is named by its Sunday."""
    return B.time_series(df, time, measures, grain, by).drop("start")


def _melt(series: DataFrame, measures: list[str], by: list[str]) -> DataFrame:
    return series.unpivot([*by, "start"], measures, "measure", "value")


def growth_table(daily: DataFrame, measures: list[str], by: list[str] = ()) -> DataFrame:
    """Growth at four grains from one daily series (already aggregated, gaps filled)."""
    by = list(by)
    parts = []
    for number, (grain, label) in enumerate(LABELS.items()):
        long = _melt(B.roll_up(daily, measures, grain, by).drop("period"), measures, by)
        parts.append(long.select(*by, F.lit(number).alias("grain_order"), F.lit(label).alias("grain"), "measure", "start", "value"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    keys = [*by, "grain_order", "grain", "measure"]
    last = W.partitionBy(*keys).orderBy(F.desc("start"))
    two = long.withColumn("back", F.row_number().over(last)).where("back <= 2")
    ends = two.groupBy(*keys).agg(
        F.max(F.when(F.col("back") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("back") == 2, F.col("value"))).alias("previous"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n = 2")
    return ends.select(
        *keys, F.round("current", 4).alias("current"), F.round("previous", 4).alias("previous"),
        growth(F.col("current"), F.col("previous")).alias("growth_percent"),
        direction(F.col("current") - F.col("previous")).alias("direction"),
    )


def period_growth(
    df: DataFrame, time: str, measures: list[str], by: list[str] = (), limit: int | None = None
) -> DataFrame:
    """Last against previous week, month, quarter and year per measure: one scan for all four."""
    measures = measures[:limit]
    daily = B.time_series(df, time, measures, "D", by)
    return growth_table(daily, measures, by).drop("grain_order")


def trend_cards(
    df: DataFrame, measures: list[str], time: str | None = None, dimension: str | None = None, limit: int | None = None
) -> DataFrame:
    """Short cards: growth over time, else leader against runner-up, else the value range."""
    if time:
        order = F.create_map(*[x for i, m in enumerate(measures) for x in (F.lit(m), F.lit(i))])[F.col("measure")]
        found = growth_table(B.time_series(df, time, measures, "D"), measures)
        return first_rows(found.orderBy("grain_order", order), limit).select(
            F.concat_ws(" ", "measure", "grain").alias("label"), F.round("current", 2).alias("value"),
            F.round("previous", 2).alias("previous"),
            F.coalesce("growth_percent", F.lit(0.0)).alias("trend"), F.col("direction").alias("trend_direction"),
        )
    if dimension:
        return leader_gap(df, dimension, measures[:limit]).select(
            F.concat(F.col("measure"), F.lit(f" by {dimension}")).alias("label"),
            F.col("leader_value").alias("value"), F.col("runner_up_value").alias("previous"),
            F.coalesce("difference_percent", F.lit(0.0)).alias("trend"),
            F.when(F.col("leader_value") >= F.col("runner_up_value"), "up").otherwise("down").alias("trend_direction"),
        )
    stats = B.numeric_stats(df, measures[:limit]).where("n >= 2")
    return stats.select(
        F.concat(F.col("column"), F.lit(" range")).alias("label"), F.round("mean", 2).alias("value"),
        F.lit(None).cast("double").alias("previous"), F.round(F.col("max") - F.col("min"), 2).alias("trend"),
        F.lit("flat").alias("trend_direction"),
    )


def leader_gap(df: DataFrame, dimension: str, measures: list[str], by: list[str] = ()) -> DataFrame:
    """Largest and second group per measure and the gap in percent; one grouped scan."""
    by = list(by)
    sums = (
        df.where(col(dimension).isNotNull())
        .groupBy(*[col(b) for b in by], col(dimension).cast("string").alias("label"))
        .agg(*[F.coalesce(F.sum(col(m)), F.lit(0)).cast("double").alias(m) for m in measures])
    )
    long = sums.unpivot([*by, "label"], measures, "measure", "value")
    keys = [*by, "measure"]
    order = W.partitionBy(*keys).orderBy(F.desc("value"), F.asc("label"))
    two = long.withColumn("rank", F.row_number().over(order)).where("rank <= 2")

    def pick(rank: int, name: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    return two.groupBy(*keys).agg(
        pick(1, "label").alias("leader"), pick(2, "label").alias("runner_up"),
        pick(1, "value").alias("a"), pick(2, "value").alias("b"), F.count(F.lit(1)).alias("_n"),
    ).where("_n = 2").select(
        *keys, "leader", "runner_up", F.round("a", 2).alias("leader_value"), F.round("b", 2).alias("runner_up_value"),
        growth(F.col("a"), F.col("b")).alias("difference_percent"),
    )


def linear_trend(df: DataFrame, time: str, measures: list[str], by: list[str] = (), min_points: int = 4) -> DataFrame:
    """Least-squares slope per day and r2 of each measure on time; combinable, no sort."""
    x = epoch_seconds(col(time)) - F.lit(946684800.0)
    found = []
    for m in measures:
        y = col(m).cast("double")
        at = F.when(y.isNotNull(), x)
        found.append(F.struct(
            F.lit(m).alias("measure"), F.count(F.when(at.isNotNull(), y)).alias("points"),
            (F.regr_slope(y, at) * 86400).alias("slope"), F.coalesce(F.regr_r2(y, at), F.lit(0.0)).alias("r2"),
        ))
    wide = df.where(col(time).isNotNull()).groupBy(*[col(b) for b in by]).agg(F.array(*found).alias("s"))
    long = wide.select(*[col(b) for b in by], F.inline("s"))
    long = long if by else B.fact(df, ("slopes", time, *measures), lambda: long)
    enough = F.col("points") >= min_points
    return long.select(
        *by, "measure", "points", F.when(enough, F.col("slope")).alias("slope_per_day"),
        F.when(enough, F.round("r2", 4)).alias("r2"),
        F.when(enough, 80 + F.floor(F.col("r2") * 20)).otherwise(50).cast("long").alias("confidence"),
        F.when(~enough, "insufficient_points").alias("note"),
    )


def _tail_change(series: DataFrame, measure: str, width: int, by: list[str]) -> DataFrame:
    """Mean of the last ``width`` periods and of the ``width`` before (all earlier ones when fewer)."""
    placed = series.select(*by, measure, B.series_position(by, descending=True).alias("back"))
    sized = placed.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    recent = F.col("back") < width
    before = (F.col("back") >= width) & ((F.col("n") < 2 * width) | (F.col("back") < 2 * width))
    return sized.groupBy(*by, "n").agg(
        F.avg(F.when(recent, F.col(measure))).alias("recent"),
        F.avg(F.when(before, F.col(measure))).alias("previous"),
    )


def quarter_growth(df: DataFrame, time: str, measure: str, by: list[str] = ()) -> DataFrame:
    """Mean of the last three months against the three before, when that mean is positive."""
    monthly = B.time_series(df, time, [measure], "M", by)
    return _tail_change(monthly, measure, 3, list(by)).where((F.col("n") >= 3) & (F.col("previous") > 0)).select(
        *by, F.round("recent", 2).alias("recent_mean"), F.round("previous", 2).alias("previous_mean"),
        F.round((F.col("recent") - F.col("previous")) / F.col("previous") * 100, 1).alias("growth_percent"),
    )


def recent_week_change(df: DataFrame, time: str, measure: str, by: list[str] = ()) -> DataFrame:
    """Mean of the last 7 days against the 7 before; flagged from 20 %, High from 35 %."""
    daily = B.time_series(df, time, [measure], "D", by)
    change = growth(F.col("recent"), F.col("previous"), 1)
    return _tail_change(daily, measure, 7, list(by)).where("n >= 8").select(
        *by, F.round("recent", 4).alias("recent_mean"), F.round("previous", 4).alias("previous_mean"),
        change.alias("change_percent"), F.coalesce(F.abs(change) >= 20, F.lit(False)).alias("flagged"),
        F.when(F.abs(change) >= 35, "High").when(F.abs(change) >= 20, "Medium").alias("impact"),
    )


def seasonality(df: DataFrame, time: str, measure: str, by: list[str] = ()) -> DataFrame:
    """Calendar months with the highest and lowest mean monthly sum (first month on ties)."""
    by = list(by)
    monthly = B.time_series(df, time, [measure], "M", by).withColumn("month", F.month("start"))
    counted = monthly.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by))).where("_n >= 4")
    means = counted.groupBy(*by, "month").agg(F.avg(measure).alias("v"))
    return means.groupBy(*by).agg(
        F.min(F.struct((-F.col("v")).alias("v"), F.col("month").alias("m"))).alias("hi"),
        F.min(F.struct(F.col("v").alias("v"), F.col("month").alias("m"))).alias("lo"),
    ).select(
        *by, F.col("hi.m").alias("peak_month"), F.col("lo.m").alias("low_month"),
        F.round(-F.col("hi.v"), 2).alias("peak_value"), F.round("lo.v", 2).alias("low_value"),
    )


def cohorts(df: DataFrame, customer: str, time: str, top: int | None = None) -> DataFrame:
    """Rows per month of first activity; two combinable aggregations instead of a window per customer."""
    per = df.where(col(time).isNotNull() & col(customer).isNotNull()).groupBy(col(customer)).agg(
        F.min(col(time)).alias("first"), F.count(F.lit(1)).alias("rows")
    )
    return first_rows(per.groupBy(F.date_format("first", "yyyy-MM").alias("cohort_month")).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("customers")
    ).orderBy(F.desc("rows"), F.asc("cohort_month")), top)


def with_pct_change(
    df: DataFrame, measures: list[str], order_by: list[str], bucket: Column, by: list[str] = ()
) -> DataFrame:
    """Add ``chg_<measure>``: relative change against the previous non-null value; infinite changes are NULL."""
    if not order_by:
        raise ValueError("rows have no order: name the columns to order by")
    prev = bucketed_previous(df, measures, order_by, bucket, by)
    return prev.select(
        *[col(c) for c in df.columns],
        *[ratio(col(m) - col(f"prev_{m}"), col(f"prev_{m}")).alias(f"chg_{m}") for m in measures],
    )


def pct_change_spikes(
    df: DataFrame, measures: list[str], order_by: list[str], bucket: Column, by: list[str] = ()
) -> DataFrame:
    """(measure, spikes, drops): changes of at least +100 % and at most -50 %."""
    changed = with_pct_change(df.select(*dict.fromkeys([*by, *order_by, *measures])), measures, order_by, bucket, by)
    return changed.agg(F.array(*[
        F.struct(
            F.lit(m).alias("measure"), F.count_if(col(f"chg_{m}") >= 1.0).alias("spikes"),
            F.count_if(col(f"chg_{m}") <= -0.5).alias("drops"),
        ) for m in measures
    ]).alias("s")).select(F.inline("s"))


def _halves(df: DataFrame, time: str, measure: str) -> DataFrame:
    used = df.where(col(time).isNotNull() & col(measure).isNotNull())
    mid = exact_median_time(used, time).select("mid").scalar()
    late = F.unix_micros(col(time).cast("timestamp")).cast("double") > mid
    return used.withColumn("_late", late)


def _half_sums(measure: str) -> list[Column]:
    v = col(measure).cast("double")
    return [
        F.coalesce(F.sum(F.when(~F.col("_late"), v)), F.lit(0.0)).alias("previous"),
        F.coalesce(F.sum(F.when(F.col("_late"), v)), F.lit(0.0)).alias("recent"),
    ]


def half_period_change(df: DataFrame, time: str, measure: str, min_rows: int = 4) -> DataFrame:
    """Sum after against sum up to the median time stamp."""
    sums = _halves(df, time, measure).agg(F.count(F.lit(1)).alias("n"), *_half_sums(measure))
    change = growth(F.col("recent"), F.col("previous"), 1)
    return sums.where((F.col("n") >= min_rows) & (F.col("previous") != 0)).select(
        F.round("previous", 2).alias("previous"), F.round("recent", 2).alias("recent"),
        change.alias("change_percent"), F.when(change < 0, "dropped").otherwise("increased").alias("direction"),
    )


def segment_deltas(df: DataFrame, time: str, measure: str, dimension: str) -> DataFrame:
    """(label, before, after, delta) per segment; a side without rows counts as 0."""
    sums = _halves(df, time, measure).where(col(dimension).isNotNull()).groupBy(
        col(dimension).cast("string").alias("label")
    ).agg(*_half_sums(measure))
    return sums.select(
        "label", F.col("previous").alias("before"), F.col("recent").alias("after"),
        (F.col("recent") - F.col("previous")).alias("delta"),
    )


def change_driver(df: DataFrame, time: str, measure: str, dimension: str) -> DataFrame:
    """The segment that moved most in the direction of the total change."""
    deltas = segment_deltas(df, time, measure, dimension)
    found = deltas.agg(
        F.sum("delta").alias("total"),
        F.min(F.struct(F.col("delta").alias("d"), F.col("label").alias("l"))).alias("down"),
        F.min(F.struct((-F.col("delta")).alias("d"), F.col("label").alias("l"))).alias("up"),
    )
    fell = F.col("total") < 0
    return found.select(
        F.round("total", 2).alias("total_change"),
        F.when(fell, F.col("down.l")).otherwise(F.col("up.l")).alias("driver"),
        F.round(F.when(fell, F.col("down.d")).otherwise(-F.col("up.d")), 2).alias("driver_change"),
    )


def date_parts(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Add year, month and weekday (Monday = 0) of time columns."""
    extra = []
    for c in columns[:limit]:
        extra += [
            F.year(col(c)).alias(f"{c}_year"), F.month(col(c)).alias(f"{c}_month"),
            F.weekday(col(c)).alias(f"{c}_dayofweek"),
        ]
    return df.select("*", *extra)
