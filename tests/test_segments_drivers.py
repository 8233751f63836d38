"""Segments on few tasks, drivers from rows added up by bins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import models as MO


def numbers(spark, rows, partitions):
    r = [F.rand(s) for s in (1, 2, 3)]
    return spark.range(rows, numPartitions=partitions).select("id", (r[0] * 40 + (F.col("id") % 3) * 300).alias("a"), r[1].alias("b"), r[2].alias("c"))


def test_bins_keep_all_rows_and_their_sums(spark):
    table = numbers(spark, 5000, 4).select((F.col("a") + F.col("b")).alias("y"), "a", "b").cache()
    got = MO._by_bins(table, "y", ["a", "b"], 2000)
    assert got.count() < 5000
    n, total, squares = got.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label")), F.sum(F.col("within") + F.col("weight") * F.col("label") ** 2)).first()
    want = table.agg(F.count("y"), F.sum("y"), F.sum(F.col("y") ** 2)).first()
    assert n == want[0] and total == pytest.approx(want[1]) and squares == pytest.approx(want[2])


def test_drivers_by_bins_are_those_of_the_rows(spark, monkeypatch):
    table = numbers(spark, 4000, 4).select((F.col("a") + 60 * F.col("b")).alias("y"), "a", "b", "c").cache()
    by_rows = {r.feature: r for r in MO.driver_importance(table, ["y", "a", "b", "c"], trees=20).collect()}
    monkeypatch.setattr(MO, "FOREST_ROWS", 1000)
    by_bins = {r.feature: r for r in MO.driver_importance(table, ["y", "a", "b", "c"], trees=20).collect()}
    for name, r in by_rows.items():
        assert by_bins[name].importance == pytest.approx(r.importance, abs=0.05) and by_bins[name].confidence_score == pytest.approx(r.confidence_score, abs=2)


def test_segments_take_few_tasks(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("segments", "")
    table = numbers(spark, 300, 64)
    segments, quality = MO.kmeans_segments(table, ["a", "b"], ["id"], max_k=3, restarts=2)
    sizes = sorted(r["count"] for r in segments.groupBy("segment").count().collect())
    tasks = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("segments") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(sizes) == 300 and quality.first().segments == 3
    assert sum(t.numTasks for t in tasks if t) < 1000
