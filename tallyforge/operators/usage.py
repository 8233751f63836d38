"""Metering, quotas, plan expiry and rate limits."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tallyforge.functions.lookups import FREE_PLAN_LIMITS, GRACE_DAYS, RATE_LIMIT, RATE_WINDOW_SECONDS
from tallyforge.functions.ordered import bucketed_previous, bucketed_running_max


def period_key(period: Column, ts: Column) -> Column:
    return (
        F.when(period == "monthly", F.date_format(ts, "yyyy-MM")).when(period == "lifetime", "lifetime")
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def limits_frame(spark, limits: list[tuple] = FREE_PLAN_LIMITS) -> DataFrame:
    """(feature, limit, period): a fixed table of a few rows."""
    return spark.createDataFrame(limits, "feature string, limit int, period string")


def usage_metering(events: DataFrame, periods: tuple[str, ...] = ("daily", "monthly", "lifetime")) -> DataFrame:
    """(user_id, feature, period, period_key, used) for all periods from one scan.

    The daily counts are formed first and rolled up, so the raw rows are grouped once.
    """
    day = events.groupBy("user_id", "feature", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    keyed = day.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    key = (
        F.when(F.col("period") == "monthly", F.substring("day", 1, 7)).when(F.col("period") == "lifetime", "lifetime")
        .otherwise(F.col("day"))
    )
    return keyed.groupBy("user_id", "feature", "period", key.alias("period_key")).agg(F.sum("n").alias("used"))


def quota_check(events: DataFrame, limits: DataFrame, premium: DataFrame | None = None) -> DataFrame:
    """Used against the limit of each feature; users in ``premium`` are unlimited."""
    metered = usage_metering(events).join(limits, ["feature", "period"])
    if premium is not None:
        marked = premium.select("user_id", F.lit(True).alias("_premium")).distinct()
        metered = metered.join(marked, "user_id", "left")
        metered = metered.withColumn("limit", F.when(F.col("_premium").isNull(), F.col("limit"))).drop("_premium")
    limit = F.col("limit")
    return metered.select(
        "user_id", "feature", "period", "period_key", "used", limit.cast("long").alias("quota"),
        F.greatest(limit - F.col("used"), F.lit(0)).cast("long").alias("remaining"),
        limit.isNull().alias("unlimited"), F.coalesce(F.col("used") >= limit, F.lit(False)).alias("blocked"),
    ).withColumn("remaining", F.when(F.col("quota").isNotNull(), F.col("remaining")))


def plan_expiry(users: DataFrame, now: Column) -> DataFrame:
    """Plan in force (paid plans end after the grace days) and days left, rounded up."""
    end = F.col("subscription_end")
    expired = (F.col("plan") == "premium") & (now > end + F.expr(f"INTERVAL {GRACE_DAYS} DAYS"))
    seconds = (F.unix_micros(end) - F.unix_micros(now)) / F.lit(1000000)
    days = F.greatest(F.ceil(seconds / 86400), F.lit(0))
    known = F.when(F.col("plan") == "premium", "premium").otherwise("free")
    return users.select(
        "user_id", "plan", F.when(F.coalesce(expired, F.lit(False)), "free").otherwise(known).alias("effective_plan"),
        F.when(end.isNotNull(), days).cast("long").alias("days_left"),
    )


def recent_event_count(
    events: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Earlier events of the same user in the last ``window_seconds`` per event.

    A user's events are cut into slices of time; only the last window of a slice is
    copied into the next one, so one busy user is counted by many tasks.
    """
    micros = F.unix_micros(F.col("ts"))
    size = max(slice_seconds, window_seconds) * 1000000
    reach = window_seconds * 1000000
    tagged = events.withColumn("_t", micros).withColumn("_slice", F.floor(F.col("_t") / F.lit(size)).cast("long"))
    near_end = F.col("_t") >= (F.col("_slice") + 1) * size - reach
    copies = F.when(near_end, F.array(F.col("_slice"), F.col("_slice") + 1)).otherwise(F.array(F.col("_slice")))
    spread = tagged.withColumn("_in", F.explode(copies))
    span = W.partitionBy("user_id", "_in").orderBy("_t").rangeBetween(-reach, 0)
    counted = spread.withColumn("recent", F.count(F.lit(1)).over(span) - 1)
    return counted.where(F.col("_in") == F.col("_slice")).drop("_t", "_slice", "_in")


def rate_limit(
    events: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS, slice_seconds: int = 3600
) -> DataFrame:
    """Upper bound of rejections: every earlier event counts, accepted or not."""
    counted = recent_event_count(events, window_seconds, slice_seconds)
    return counted.withColumn("over_limit", F.col("recent") >= limit)


def admit(times, accepted: deque, limit: int, window: float) -> list[bool]:
    """Accept or reject ordered times; only accepted ones count. ``accepted`` is updated in place."""
    verdicts = []
    for t in times:
        while accepted and t - accepted[0] > window:
            accepted.popleft()
        free = len(accepted) < limit
        if free:
            accepted.append(t)
        verdicts.append(free)
    return verdicts


def rate_limit_exact(
    events: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS
) -> DataFrame:
    """(user_id, event_id, ts, accepted): the exact rule for a finished table.

    A pause longer than the window empties the queue, so a user's events fall into
    independent bursts. Bursts are spread over tasks, each task reads them in time
    order batch by batch and keeps at most ``limit`` times in memory. Only bursts with
    more than ``limit`` events in a window are walked event by event.
    """
    micros = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("_t"))
    order = ["_t", "event_id"]
    day = F.floor(F.col("_t") / F.lit(86400000000)).cast("long")
    reach = window_seconds * 1000000
    before = bucketed_previous(micros, ["_t"], order, day, ["user_id"])
    starts = F.when(F.col("prev__t").isNull() | (F.col("_t") - F.col("prev__t") > reach), F.col("_t"))
    bursts = bucketed_running_max(before.withColumn("_start", starts), "_start", order, day, ["user_id"], "_burst")
    placed = bursts.repartition("user_id", "_burst").sortWithinPartitions("user_id", "_burst", "_t", "event_id")
    schema = T.StructType([events.schema["user_id"], events.schema["event_id"], events.schema["ts"],
                           T.StructField("accepted", T.BooleanType())])

    def judge(batches):
        current, queue = None, deque()
        for batch in batches:
            if not len(batch):
                continue
            t, keys = batch["_t"].to_numpy(), batch[["user_id", "_burst"]]
            fresh = (keys != keys.shift()).any(axis=1).to_numpy()
            fresh[0] = True
            group, starts = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(t))
            goes_on = tuple(keys.iloc[0]) == current
            # a burst in which no event has ``limit`` others before it within the window is accepted whole
            crowded = np.unique(group[limit:][(group[limit:] == group[:-limit]) & (t[limit:] - t[:-limit] <= reach)]) if limit else np.arange(len(starts) - 1)
            verdicts, last = np.ones(len(t), bool), len(starts) - 2
            for g in sorted({*crowded.tolist(), *([0] if goes_on else [])}):
                own = queue if g == 0 and goes_on else deque()
                verdicts[starts[g]:starts[g + 1]] = admit(t[starts[g]:starts[g + 1]].tolist(), own, limit, reach)
                if g == last:
                    queue = own
            if not (last in crowded or goes_on and last == 0):
                queue = deque(t[max(starts[last], len(t) - limit):].tolist())
            current = tuple(keys.iloc[-1])
            yield batch[["user_id", "event_id", "ts"]].assign(accepted=verdicts)

    return placed.select("user_id", "event_id", "ts", "_t", "_burst").mapInPandas(judge, schema)
