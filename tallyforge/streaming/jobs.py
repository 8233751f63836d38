"""Live forms: usage counts, rate limits, repeat uploads, daily totals."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyforge.functions.lookups import RATE_LIMIT, RATE_WINDOW_SECONDS
from tallyforge.functions.ordered import bucketed_previous
from tallyforge.functions.semantics import growth
from tallyforge.operators.usage import admit


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; its time stamps become TIMESTAMP for watermarks."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    zoned = [F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
             for f in schema]
    return df.select(*zoned)


def stream_usage(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily counts per user and feature; a day is emitted once it is closed by the watermark."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "user_id", "feature").agg(
        F.count(F.lit(1)).alias("used")
    )
    return counted.select("user_id", "feature", F.date_format("w.start", "yyyy-MM-dd").alias("period_key"), "used")


def stream_rate_limit(
    events: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS, delay: str = "1 hour"
) -> DataFrame:
    """(user_id, event_id, ts, accepted): the exact rule with at most ``limit`` times of state per user.

    Events of one micro-batch are judged in time order; the state expires in event
    time, once the watermark has passed the last accepted event by the window.
    """
    out = T.StructType([events.schema["user_id"], events.schema["event_id"], events.schema["ts"],
                        T.StructField("accepted", T.BooleanType())])
    state_type = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])

    def judge(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = deque(state.get[0] if state.exists else [])
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        rows["accepted"] = admit(micros.tolist(), accepted, limit, window_seconds * 1000000)
        state.update((list(accepted),))
        expires = int(micros.iloc[-1]) // 1000 + window_seconds * 1000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield rows[["user_id", "event_id", "ts", "accepted"]]

    marked = events.withWatermark("ts", delay)
    return marked.groupBy("user_id").applyInPandasWithState(judge, out, state_type, "append", "EventTimeTimeout")


def stream_dedup(uploads: DataFrame, key: str = "dataset_hash", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first upload of each content hash within the watermark delay."""
    return uploads.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain what has arrived into Parquet below ``path`` and return the result as a batch frame."""
    spark = df.sparkSession
    stream = (
        df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """Finished versions below ``folder`` and their paths."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    paths = [str(f.getPath().toString()) for f in fs.listStatus(root)]
    done = [p for p in paths if "/version=" in p and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    return {int(p.rsplit("=", 1)[1]): p for p in done}


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stream_trend(events: DataFrame, path: str, measure: str = "value", delay: str = "1 hour") -> DataFrame:
    """(day, total, records, growth_percent) kept current: daily totals and their change against the previous day with records.

    Every micro-batch merges its changed days into the table of days and writes the next version; versions before the last one are
    deleted, so the folder holds two tables of days at most. A restart repeats a batch from the same earlier version, so totals are never
    counted twice. Rows without a time are dropped; without any rows the result is empty.
    """
    spark = events.sparkSession
    folder, columns = f"{path}/days", ["day", "total", "records"]
    daily = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.sum(measure).alias("total"), F.count(F.lit(1)).alias("records")
    ).select(F.col("w.start").alias("day"), "total", "records")

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = {n: p for n, p in _versions(session, folder).items() if n < number}
        days = batch.withColumn("newer", F.lit(1))
        if earlier:
            known = session.read.schema(daily.schema).parquet(earlier[max(earlier)])
            days = days.unionByName(known.withColumn("newer", F.lit(0)))
        kept = days.groupBy("day").agg(F.max_by(F.struct("total", "records"), "newer").alias("v")).select("day", "v.total", "v.records")
        kept.write.mode("overwrite").parquet(f"{folder}/version={number}")
        for old in sorted(earlier)[:-1]:
            _drop(session, earlier[old])

    stream = (
        daily.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    written = _versions(spark, folder)
    days = spark.read.schema(daily.schema).parquet(written[max(written)]) if written else spark.createDataFrame([], daily.schema)
    ranked = bucketed_previous(days, ["total"], ["day"], F.date_trunc("month", "day"))
    return ranked.select(*columns, growth(F.col("total"), F.col("prev_total")).alias("growth_percent"))
