"""Queries return everything that their tables hold, checked without their registered SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pytest
from oracle import compare, connect, rows_of
from pyspark.sql import functions as F

from tallyforge.functions import series_trees
from tallyforge.operators import forecast as FO
from tallyforge.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def test_tickets_of_every_status(spark):
    want = connect(FOLDER).execute("""SELECT o_orderkey, c_custkey, c_name || '@example.org', o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey""").fetchall()
    got = REGISTRY["j2_inner_join"][0](spark, FOLDER).select("ticket_id", "user_id", "email", "status")
    columns = list("abcd")
    assert rows_of(columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want)
    assert len({r[3] for r in want}) > 1


def test_search_returns_every_match(spark):
    want = connect(FOLDER).execute("""SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'
        ORDER BY o_orderkey % 100 = 0 DESC, o_orderdate DESC, o_orderkey DESC""").fetchall()
    got = REGISTRY["j5_search_history"][0](spark, FOLDER).collect()
    assert [r.upload_id for r in got] == [k for k, in want] and len(want) > 50


@pytest.fixture(scope="module")
def points(spark):
    """Series of 60 days (of the second only the last two days are high), one of 7 days, one with nulls and one that is constant, in two groups."""
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).cast("timestamp").alias("start"), F.col("id").cast("double").alias("x"))
    y = {"a": F.col("x") * 2, "b": F.when(F.col("x") >= 58, 500.0).otherwise(F.col("x") % 7), "short": F.when(F.col("x") < 7, F.col("x")),
         "holes": F.when(F.col("x") % 3 > 0, F.sin("x")), "flat": F.lit(4.0)}
    rows = [days.select(F.lit(g).alias("series"), F.lit(m).alias("measure"), "start", "x", (v * k).alias("y")) for m, v in y.items() for k, g in ((1, "one"), (3, None))]
    return reduce(lambda p, q: p.unionByName(q), rows)


def grown_forest(y, trees):
    """Trees grown by recursive splits to pure leaves, as a forest library does it."""
    def grow(xs, ys):
        if len(set(ys)) == 1:
            return ys[0]
        best = None
        for cut in sorted(set(xs))[:-1]:
            left, right = [v for x, v in zip(xs, ys, strict=True) if x <= cut], [v for x, v in zip(xs, ys, strict=True) if x > cut]
            loss = sum((v - np.mean(left)) ** 2 for v in left) + sum((v - np.mean(right)) ** 2 for v in right)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, cut, min(x for x in xs if x > cut))
        _, low, high = best
        parts = [[(x, v) for x, v in zip(xs, ys, strict=True) if (x <= low) == side] for side in (True, False)]
        return (low + high) / 2, *(grow(*zip(*part, strict=True)) for part in parts)

    def answer(tree, x):
        while isinstance(tree, tuple):
            tree = tree[1] if x <= tree[0] else tree[2]
        return tree

    grown = []
    for t in range(trees):
        drawn = series_trees.drawn_positions(len(y), t).tolist()
        grown.append(grow(drawn, [float(y[k]) for k in drawn]))
    return [float(np.mean([answer(t, x) for t in grown])) for x in range(len(y) + 1)]


def test_closed_form_equals_grown_trees():
    rng = np.random.default_rng(1)
    for n in (8, 13, 30):
        y = rng.normal(size=n).round(1)
        fit = grown_forest(y, 7)
        ahead, score = series_trees.forest(y, 7)
        assert ahead == pytest.approx(fit[-1])
        assert score == pytest.approx(max(0, 1 - ((y - fit[:-1]) ** 2).sum() / ((y - y.mean()) ** 2).sum()))
    assert series_trees.forest(np.full(9, 3.0), 5) == (3.0, 1.0)
    share = np.mean([len(np.unique(series_trees.drawn_positions(2000, t))) / 2000 for t in range(80)])
    assert abs(share - (1 - np.exp(-1))) < 0.01  # as many distinct days as a bootstrap draws


def test_boosted_rounds_equal_brute_force():
    def cut(r, a, b, depth):
        whole = r[a:b].sum() ** 2 / (b - a + 1)
        gains = [(r[a:i].sum() ** 2 / (i - a + 1) + r[i:b].sum() ** 2 / (b - i + 1) - whole, -i) for i in range(a + 1, b)]
        if not depth or not gains or max(gains)[0] <= 1e-9:
            return [(a, b)]
        i = -max(gains)[1]
        return cut(r, a, i, depth - 1) + cut(r, i, b, depth - 1)

    y = np.random.default_rng(5).normal(size=70).cumsum()
    fit = np.full(70, y.mean())
    for _ in range(6):
        r = y - fit
        for a, b in cut(r, 0, 70, 3):
            fit[a:b] += 0.3 * r[a:b].sum() / (b - a + 1)
    assert series_trees.boosted(y, 6, depth=3) == pytest.approx(fit)
    assert series_trees.boosted(np.full(8, 2.0), 80) == pytest.approx(np.full(8, 2.0))


def test_tree_forecasts_have_every_step_of_every_series(points):
    for model in ("forest", "boosted"):
        got = FO.tree_forecast(points, model, by=["series"]).collect()
        assert {(r.series, r.measure) for r in got} == {(g, m) for g in ("one", None) for m in ("a", "b", "holes", "flat")}
        assert sorted(r.step for r in got if r.measure == "a" and r.series is None) == list(range(1, 31))
        one = {r.measure: r for r in got if r.series == "one" and r.step == 30}
        # the last leaf resolves the last days
        assert one["b"].predicted_value > 400 and one["flat"].predicted_value == pytest.approx(4.0) and str(one["b"].period) == "2024-03-30"
        assert all(r.predicted_value == pytest.approx(3 * one["a"].predicted_value) for r in got if r.measure == "a" and r.series is None)
    assert FO.tree_forecast(points.where("x < 7"), by=["series"]).count() == 0 and FO.tree_forecast(points.limit(0)).count() == 0


def test_choice_is_among_linear_forest_and_boosted(points):
    rows = FO.forecast_candidates(points, by=["series"]).where("series = 'one'").collect()
    models = {"Gradient Boosted Trees", "Random Forest", "Linear trend fallback"}
    assert {(r.measure, r.model) for r in rows} == {(m, n) for m in ("a", "b", "holes", "flat") for n in models}
    chosen = FO.select_forecast(FO.forecast_candidates(points, by=["series"]), ["series"]).where("series = 'one'").collect()
    best = {m: max((r for r in rows if r.measure == m), key=lambda r: r.confidence) for m in ("a", "b", "holes", "flat")}
    assert {r.measure: r.model for r in chosen} == {m: r.model for m, r in best.items()}
    assert all(r.predicted_value == pytest.approx(best[r.measure].predicted_value, abs=0.0051) for r in chosen)  # shown with two digits


def test_ties_of_confidence_go_to_the_first_candidate(spark):
    rows = [("m", name, 1.0, float(k), 0.78) for k, name in enumerate(("Random Forest", "Linear trend fallback", "Gradient Boosted Trees"))]
    table = spark.createDataFrame(rows, "measure string, model string, current_value double, predicted_value double, confidence double")
    assert FO.select_forecast(table).first().model == "Gradient Boosted Trees"
    assert FO.select_forecast(table.where("predicted_value < 2")).first().model == "Random Forest"


@pytest.mark.parametrize("name", ["ml9_forest_forecast", "ml11_select_forecast", "j2_inner_join", "j5_search_history"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, *REGISTRY[name], FOLDER) is None
