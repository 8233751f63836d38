"""Many plans answered together equal the plans answered one by one."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import ask as ASK
from tallyforge.plans.answers import ANSWER, answer_plans

DIMS, NUMBERS = ["city", "item_name"], ["revenue", "qty"]


@pytest.fixture(scope="module")
def sold(spark):
    rng = random.Random(5)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(3000)), rng.choice(["Rome", "Oslo", "Lima", None]), f"item {rng.randrange(40)}",
             rng.choice([None, round(rng.random() * 50, 2), round(rng.random() * 5000, 2)]), rng.randrange(9)) for _ in range(400)]
    rows += rows[:7]
    return spark.createDataFrame(rows, "order_date timestamp, city string, item_name string, revenue double, qty long")


def _rows(frame):
    return sorted([[round(v, 6) if isinstance(v, float) else v for v in r] for r in frame.select(*ANSWER).collect()], key=str)


def test_every_plan_equals_its_single_answer(spark, sold):
    plans = [("rows", None, None, 1), ("columns", None, None, 1), ("quality", None, None, 1), ("unknown", None, None, 1), ("leader", None, "qty", 1), ("odd", None, None, 1)]
    plans += [(k, d, None, n) for d in DIMS for k, n in (("unique_count", 1), ("weakest", 1), ("top_count", 3), ("top_count", 25), ("most_common", 1), ("advice", 1))]
    plans += [(k, None, m, 1) for m in NUMBERS for k in ("highest_value", "average", "outliers", "why_change")]
    plans += [(k, d, m, n) for d in DIMS for m in NUMBERS for k, n in (("weakest", 1), ("top_n", 2), ("top_n", 25), ("leader", 1), ("advice", 1), ("why_change", 1))]
    asked = spark.createDataFrame(plans, "intent string, dimension string, measure string, n int")
    whole = {k: (lambda k=k: ASK.answer_plan(sold, k, None, None)) for k in ("rows", "columns", "quality", "unknown")}
    found = answer_plans(sold, asked.unionByName(asked), "order_date", whole).collect()
    frame = spark.createDataFrame(found, "intent string, dimension string, measure string, n int, answer_type string, label string, value double, share double, text string")
    for intent, dimension, measure, n in random.Random(1).sample(plans, 9):
        own = frame.where(F.col("intent").eqNullSafe(intent) & F.col("dimension").eqNullSafe(dimension) & F.col("measure").eqNullSafe(measure) & (F.col("n") == n))
        assert _rows(own) == _rows(ASK.answer_plan(sold, intent, dimension, measure, n)), (intent, dimension, measure, n)


def test_questions_without_rows_and_tables_without_rows(spark, sold):
    none = spark.createDataFrame([], "id long, question string")
    assert ASK.ask_many(sold, none).count() == 0
    asked = spark.createDataFrame([(1, "how many rows"), (2, None), (3, ""), (4, "top 3 city by revenue"), (5, "why did revenue change"), (6, "how many rows")], "id long, question string")
    got = {}
    for r in ASK.ask_many(sold.limit(0), asked).collect():
        got.setdefault(r.id, []).append(r.value)
    assert got[1] == got[6] == [0.0] and 4 not in got and 5 not in got
    full = ASK.ask_many(sold, asked).collect()
    assert [r.value for r in full if r.id == 1] == [407.0] and sum(r.id == 4 for r in full) == 3
