"""Questions read a table that is written once: the joins behind it do not run again, with a side on the driver, for every aggregation."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.plans import ask as ASK


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joins_behind_the_table_run_once(spark, monkeypatch):
    day, seen, answer = dt.datetime(2024, 1, 1), [], ASK.answer_plans
    monkeypatch.setattr(ASK, "answer_plans", lambda df, *rest: seen.append(df) or answer(df, *rest))
    lines = spark.createDataFrame([(i, i % 3, day + dt.timedelta(days=i), float(i)) for i in range(9)] + [(8, 2, day + dt.timedelta(days=8), 8.0), (None, None, None, None)],
                                  "id long, k long, order_date timestamp, revenue double")
    names = spark.createDataFrame([(0, "Rome"), (1, "Oslo"), (2, "Lima"), (None, "lost")], "k long, city string")
    sold = lines.join(names, "k").withColumn("note", F.lit(None)).withColumn("Cost net", F.col("revenue") / 2)
    asked = ["top 2 city by revenue", "why did revenue change", "how many rows", "average revenue", "any outlier in revenue", "is there a duplicate", "list the fields", "number of city"]
    questions = spark.createDataFrame(list(enumerate(asked)), "id long, question string")
    got = sorted(((r.id, r.answer_type, r.label, r.value, r.share, r.text) for r in ASK.ask_many(sold, questions).collect()), key=str)
    assert "Join" in _plan(sold) and len(seen) == 1 and "Join" not in _plan(seen[0])
    assert seen[0].dtypes == sold.dtypes
    want = [(i, *r) for i, q in enumerate(asked) for r in ASK.ask(sold, q).select("answer_type", "label", "value", "share", "text").collect()]
    assert got == sorted(want, key=str)


def test_tables_that_files_cannot_hold_are_asked_as_they_are(spark):
    odd = spark.range(3).select(F.col("id").cast("string").alias("city"), F.array().alias("a"))
    asked = spark.createDataFrame([(1, "how many rows")], "id long, question string")
    assert [r.value for r in ASK.ask_many(odd, asked).collect()] == [3.0]


def test_a_plan_names_the_normalised_question_once(spark):
    sold = spark.createDataFrame([("Rome", 1.0)], "city string, revenue double")
    asked = spark.createDataFrame([(1, "Kitne CITY", 7, 8)], "id long, question string, _q int, _P int")
    planned = ASK.plan_questions(sold, asked)
    assert _plan(planned).count("kitne") == 1
    assert planned.columns == ["id", "question", "_q", "_P", "intent", "dimension", "measure", "n"]
    assert [tuple(r) for r in planned.collect()] == [(1, "Kitne CITY", 7, 8, "rows", None, None, 1)]
