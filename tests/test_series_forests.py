"""Forests of many series share their draws, and series are neither joined with a calendar nor shuffled twice."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import series_trees
from tallyforge.operators import backbone as B, forecast as FO


def test_series_of_one_length_share_draws(monkeypatch):
    drawn, calls = series_trees.drawn_positions, []
    monkeypatch.setattr(series_trees, "drawn_positions", lambda n, tree: calls.append((n, tree)) or drawn(n, tree))
    rng = np.random.default_rng(3)
    series = [rng.normal(size=n) for n in (9, 30, 9, 9, 30)]
    found = series_trees.forests(series, 6)
    assert len(calls) == 12
    for y, (ahead, _) in zip(series, found):
        picks = [np.unique(drawn(len(y), t)) for t in range(6)]
        assert np.isclose(ahead, np.mean([y[p[-1]] for p in picks]))
        fit = [np.mean([y[min(p, key=lambda d: (abs(d - i), d))] for p in picks]) for i in range(len(y))]
        r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert np.isclose(found[[id(s) for s in series].index(id(y))][1], max(0.0, r2))


def test_many_series_in_two_shuffles(spark):
    day = dt.datetime(2024, 2, 25)
    rows = [(k, day + dt.timedelta(days=2 * i + (i > 4)), float(i * k)) for k in range(3) for i in range(9)] + [(None, day, 5.0), (None, day + dt.timedelta(days=9), 5.0)]
    df = spark.createDataFrame(rows, "k int, t timestamp, v double")
    points = FO.daily_points(df, "t", ["v"], ["k"])
    got = [(r["start"], r["x"], r["y"]) for r in points.where("k = 2").orderBy("x").collect()]
    assert [x for _, x, _ in got] == list(range(18)) and [s for s, _, _ in got] == [day + dt.timedelta(days=i) for i in range(18)]
    assert [y for _, _, y in got] == [2.0 * i if keep else 0.0 for i, keep in [(0, 1), (0, 0), (1, 1), (0, 0), (2, 1), (0, 0), (3, 1), (0, 0), (4, 1), (0, 0), (0, 0), (5, 1), (0, 0), (6, 1), (0, 0), (7, 1), (0, 0), (8, 1)]]
    found = FO.tree_forecast(points, "forest", by=["k"])
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert {r["k"] for r in found.select("k").distinct().collect()} == {0, 1, 2, None}
    assert found.count() == 4 * FO.HORIZON
    months = B.time_series(df.where("k = 1"), "t", ["v"], "M", position="at").orderBy("at").select("period", "v", "at").collect()
    assert [(r["v"], r["at"]) for r in months] == [(3.0, 0.0), (33.0, 1.0)]
    assert points.where(F.col("k").isNull()).agg(F.sum("y")).first()[0] == 0.0
