"""Unit and property tests on small hand-made frames."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.quantile import exact_quantiles
from tallyforge.functions.semantics import nan_to_null
from tallyforge.operators import (
    anomaly as A, clean as C, forecast as FO, grouped as G, kpi as K, multivariate as M, normalize as N, profile as P,
    trend as TR, usage as U,
)
from tallyforge.plans import ask as ASK
from tallyforge.sources import readers as R


@pytest.fixture(scope="module")
def tiny_sales(spark):
    days = [dt.datetime(2020, 1, d) for d in range(1, 6)]
    return spark.createDataFrame(list(zip(days, [10, 20, 30, 40, 50], "abaca")), "order_date timestamp, revenue long, product string")


def test_outlier_column_is_reported(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1, 1, 1, 1, 100])], "i long, x long")
    found = A.rule_anomalies(df, ["i"], F.lit(0), ["x"], z_threshold=1.5).first()
    assert found["column"] == "x" and found["anomaly_count"] >= 1


def test_correlated_pair_is_found(spark):
    df = spark.createDataFrame(list(zip(range(1, 6), [2, 4, 6, 8, 10], [5, 3, 6, 2, 1])), "a long, b long, c long")
    pairs = {(r["col_a"], r["col_b"]) for r in G.top_correlations(df, top=5, threshold=0.5).collect()}
    assert ("a", "b") in pairs


def test_rising_days_have_slope_one(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1 + i), i) for i in range(10)], "date timestamp, value long")
    row = TR.linear_trend(df, "date", ["value"]).first()
    assert row["slope_per_day"] == pytest.approx(1.0) and row["r2"] == 1.0 and row["confidence"] == 100


def test_discovered_kpis(tiny_sales):
    found = {r["kpi"]: (r["value"], r["text"]) for r in K.discovered_kpis(tiny_sales, "order_date").collect()}
    assert found["Row Count"][0] == 5 and found["revenue Total"][0] == 150
    assert found["Top product"][1] == "a" and found["Top product %"][0] == 60


def test_quantiles_match_numpy_for_groups_of_any_size(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([rng.gauss(0, 9), rng.randint(0, 4)]))) for g, n in ((1, 1), (2, 2), (3, 7), (4, 4000), (5, 60000)) for _ in range(n)]
    found = exact_quantiles(spark.createDataFrame(rows, "g int, x double"), ["x"], [0.75, 0.25, 0.5], ["g"]).collect()
    for r in found:
        values = [x for g, x in rows if g == r["g"]]
        assert r["q"] == pytest.approx(list(np.quantile(values, [0.75, 0.25, 0.5])))


def test_edge_cases(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "a long, b double")
    assert P.missing_summary(none).first()["missing_columns"] == 1
    assert P.outlier_counts(none.withColumn("b", F.lit(7.0)), ["b"]).count() == 0
    nan = nan_to_null(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double"))
    assert nan.where("x IS NULL").count() == 2
    empty = spark.createDataFrame([], "a long, t string")
    assert P.shape(empty).first()["rows"] == 0 and P.quality_score(empty).first()["quality_score"] == 0.0
    with pytest.raises(ValueError):
        R.reject_empty(empty)
    with pytest.raises(ValueError):
        R.read_dataset(spark, "/tmp/file.pdf")


def test_names():
    assert N.sanitize_names([" a  b", "a b", ""]) == (["a b", "a b_2", "column"], ["a b"])
    assert N.snake_names(["A-b!", "a b", "%"]) == ["a_b", "a_b_2", "column"]


def test_growth_skips_zero_previous_and_fills_gaps(spark):
    rows = [(dt.datetime(2020, 1, 5), 0.0), (dt.datetime(2020, 4, 5), 8.0)]
    df = spark.createDataFrame(rows, "t timestamp, v double")
    months = TR.resample_sum(df, "t", ["v"], "M").orderBy("period").collect()
    assert [r["v"] for r in months] == [0.0, 0.0, 0.0, 8.0]
    row = TR.period_growth(df, "t", ["v"]).where("grain = 'MoM'").first()
    assert row["growth_percent"] is None and row["direction"] == "up"


def test_segment_on_one_side_only_counts_as_zero(spark):
    rows = [(dt.datetime(2020, 1, d), "old", 5.0) for d in range(1, 4)] + [(dt.datetime(2020, 1, d), "new", 50.0) for d in range(4, 6)]
    df = spark.createDataFrame(rows, "t timestamp, s string, v double")
    assert TR.change_driver(df, "t", "v", "s").first()["driver"] == "new"


def test_clean_dataset_has_no_holes_and_no_repeats(spark):
    rows = [("₹1,200", "x ", "2024-01-01"), ("₹1,200", "x ", "2024-01-01"), ("$5", None, "2024-01-02"), ("12%", "y", None), ("7", "y", "2024-01-03")]
    cleaned, report = C.clean_dataset(spark.createDataFrame(rows, "`The Price` string, label string, `Order Date` string"))
    assert cleaned.columns == ["the_price", "label", "order_date"] and dict(cleaned.dtypes)["the_price"] == "double"
    assert cleaned.count() == 4 and P.missing_summary(cleaned).first()["missing_cells"] == 0
    assert report.first()["duplicates_removed"] == 1 and report.first()["missing_filled"] == 2


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y,z\n3,é\n", encoding="latin-1")
    rows = R.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["b"] for r in rows if r["a"] in ("1", "3")] == ["x", "é"]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert R.read_json(spark, str(tmp_path / "a.json")).count() == 2


def test_rate_limit_equals_plain_loop(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(u, i * 10 + u, base + dt.timedelta(seconds=rng.randint(0, 3000))) for u in range(3) for i in range(200)]
    got = {r["event_id"]: r["accepted"] for r in U.rate_limit_exact(spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp"), 5, 60).collect()}
    for u in range(3):
        kept: list = []
        for _, event, ts in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            kept = [t for t in kept if (ts - t).total_seconds() <= 60]
            assert got[event] == (len(kept) < 5)
            if len(kept) < 5:
                kept.append(ts)


def _planted(spark):
    rng = np.random.default_rng(1)
    data = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(12, 1, (300, 2)), [[40.0, -40.0], [-30.0, 55.0]]])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(data)], "id int, a double, b double"), data


def test_planted_outliers_and_noise_against_brute_force(spark):
    df, data = _planted(spark)
    flagged = {r["id"] for r in M.isolation_forest(df, "id", ["a", "b"], threshold=0.6).collect()}
    assert {600, 601} <= flagged and len(flagged) < 60
    again = {r["id"] for r in M.isolation_forest(df.repartition(7), "id", ["a", "b"], threshold=0.6).collect()}
    assert flagged == again
    z = (data - data.mean(0)) / data.std(0)
    gap = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    near = gap <= 0.3
    core = near.sum(1) >= 8
    noise = {i for i in range(len(z)) if not near[i, core].any()}
    assert {r["id"] for r in M.density_noise(df, "id", ["a", "b"], eps=0.3, min_samples=8).collect()} == noise


def test_forecast_of_a_line_is_the_line(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 2.0 * i + 1) for i in range(20)], "t timestamp, v double")
    rows = FO.forecast(df, "t", ["v"], steps=3).orderBy("step").collect()
    assert [r["forecast"] for r in rows] == pytest.approx([41.0, 43.0, 45.0]) and rows[0]["upper"] == pytest.approx(41.0)


def test_questions(tiny_sales):
    assert ASK.ask(tiny_sales, "top product by revenue").first()["label"] == "a"
    assert ASK.ask(tiny_sales, "How many products?").first()["value"] == 3
    assert ASK.ask(tiny_sales, "delivery status of the warehouse").first()["answer_type"] == "unknown"
    assert ASK.ask(tiny_sales, "average revenue").first()["value"] == statistics.mean([10, 20, 30, 40, 50])
