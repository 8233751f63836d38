"""Steps that several statistics read are computed once, with the same rows and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import clean as C
from tallyforge.queries import insight_queries as IQ, profile_queries as PQ
from tallyforge.queries.base import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_written_keeps_rows_and_types(spark):
    table = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.5)], "i int, s string, d double").select("*", F.lit(None).alias("v"), F.lit("x").alias("a b.c"))
    got = C._written(table.dropDuplicates())
    assert got.dtypes == table.dtypes and "Aggregate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", None, None, "x"), (2, None, 0.5, None, "x")]


def test_signals_share_their_lines(spark, monkeypatch):
    lines = spark.range(60).select(
        (F.col("id") % 2).alias("dataset_id"), F.timestamp_seconds(F.col("id") * 86400 * 9).alias("ship_date"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand"),
        (F.col("id") * 1.0).alias("revenue"), F.lit(2.0).alias("quantity"), (F.col("id") * 3.0).alias("tail"))
    monkeypatch.setattr(Tables, "supplier_lines", property(lambda self: lines.join(spark.range(2).withColumnRenamed("id", "dataset_id"), "dataset_id")))
    signals = IQ.Signals(spark, "none")
    assert signals.lines.count() == 60 and "Join" not in plan(signals.lines)
    assert signals.anomalies is signals.anomalies and signals.insights is signals.insights and "Aggregate" not in plan(signals.insights)


def test_cubes_are_joined_once(spark, monkeypatch):
    sales = spark.range(9).select(F.col("id").alias("order_id"), F.lit(2.0).alias("revenue"), F.lit(1.0).alias("quantity"))
    monkeypatch.setattr(Tables, "sales", property(lambda self: sales.join(spark.range(9).withColumnRenamed("id", "order_id"), "order_id")))
    cubes = PQ._cubes(spark, "none")
    assert cubes.count() == 9 and "Join" not in plan(cubes)
