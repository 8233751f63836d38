"""The live trend over several drops of files and restarts."""

from __future__ import annotations

import os

from tallyforge.streaming import jobs as ST

SCHEMA = "ts timestamp, value double"


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, "t string, value double").selectExpr("CAST(t AS timestamp) AS ts", "value").coalesce(1).write.parquet(f"{folder}/{name}")


def trend(spark, folder, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    rows = ST.stream_trend(stream, path, delay="3 days").orderBy("day").collect()
    return [(str(r.day)[:10], r.total, r.records, r.growth_percent) for r in rows]


def test_trend_with_growth_over_restarts_and_two_versions_at_most(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "state")
    drop(spark, folder, "a", [("2024-01-31 10:00:00", 10.0), ("2024-02-01 10:00:00", 30.0), (None, 5.0)])
    drop(spark, folder, "b", [("2024-02-03 10:00:00", 15.0), ("2024-02-01 11:00:00", None)])
    assert trend(spark, folder, path) == [("2024-01-31", 10.0, 1, None), ("2024-02-01", 30.0, 2, 200.0), ("2024-02-03", 15.0, 1, -50.0)]
    assert trend(spark, folder, path) == trend(spark, folder, path)
    drop(spark, folder, "c", [("2024-02-01 12:00:00", 30.0)])
    drop(spark, folder, "d", [("2024-02-04 12:00:00", 0.0)])
    drop(spark, folder, "e", [("2024-02-05 12:00:00", 1.0)])
    assert trend(spark, folder, path) == [
        ("2024-01-31", 10.0, 1, None), ("2024-02-01", 60.0, 3, 500.0), ("2024-02-03", 15.0, 1, -75.0), ("2024-02-04", 0.0, 1, -100.0), ("2024-02-05", 1.0, 1, None)]
    assert len([v for v in os.listdir(f"{path}/days") if v.startswith("version=")]) <= 2


def test_trend_of_an_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(spark, folder, "a", [("2024-01-31 10:00:00", 1.0)])
    spark.read.schema(SCHEMA).parquet(f"{folder}/a").where("false").write.mode("overwrite").parquet(f"{folder}/a2")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/a2")
    result = ST.stream_trend(stream, str(tmp_path / "state"))
    assert result.columns == ["day", "total", "records", "growth_percent"] and result.count() == 0
