"""Repeats counted by hashes of rows: equal to grouping whole rows, and no wide row travels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import backbone as B

ROWS = [
    ("a", None, 1.0, [1, None]), (None, "a", 1.0, [1, None]), ("a", None, 1.0, [None, 1]), ("a", None, 1.0, [1, None]), ("ab", "c", 0.0, []), ("a", "bc", 0.0, []),
    ("ab", "c", -0.0, []), ("n", "n", float("nan"), None), ("n", "n", float("nan"), None), (None, None, None, None), (None, None, None, None), ("", None, None, None),
]


def test_equal_to_whole_rows(spark):
    table = spark.createDataFrame(ROWS, "x string, y string, `v.w` double, l array<int>")
    for columns in (["x", "y", "v.w", "l"], ["x", "y"], ["x", "y", "v.w"], ["l"]):
        groups = table.groupBy(*[f"`{c}`" for c in columns]).count().count()
        assert tuple(B.duplicate_stats(table, columns).first()) == (len(ROWS), len(ROWS) - groups)
    assert tuple(B.duplicate_stats(table.where("false")).first()) == (0, 0)


def test_only_hashes_travel(spark):
    table = spark.range(100).select(F.concat(F.lit("some wide text "), "id").alias("text"), (F.col("id") % 3).alias("k"))
    plan = B.duplicate_stats(table)._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert grouped and all("text" not in line for line in grouped)
