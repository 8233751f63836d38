"""The battery computes what its sections share once, and a remembered table gives the same rows as any other."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.ordered import bucketed_previous
from tallyforge.operators import anomaly as A, backbone as B, grouped as G, insight as I, kpi as K, profile as P, trend as TR
from tallyforge.plans.analysis import run_analysis
from tallyforge.session import staged_table

NUMBERS = ["revenue", "cost", "units"]


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for k in range(400):
        when = None if k % 41 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=k // 2, hours=k % 5)
        revenue = None if k % 17 == 0 else 0.0 if k % 19 == 0 else -0.0 if k % 23 == 0 else float((k * 37) % 211) / 4 + (5000 if k == 333 else 0)
        rows.append((k // 3, when, f"c{k % 9}" if k % 13 else None, "7.5" if k % 10 else "x", revenue, float(k % 7), k % 5))
    rows += rows[:20]
    return spark.createDataFrame(rows, "order_id long, day timestamp, customer string, code string, revenue double, cost double, units int").repartition(3)


def same(a, b):
    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in a.collect()) == sorted(tuple(map(plain, r)) for r in b.collect())


@pytest.mark.parametrize("section", [
    lambda d: B.numeric_summary(d, NUMBERS), lambda d: B.distinct_counts(d), lambda d: B.distinct_counts(d, ["revenue", "code"]), lambda d: B.top_values(d, ["customer", "code"], 3),
    lambda d: B.duplicate_stats(d), lambda d: P.inspect_dataset(d), lambda d: P.health_score_weighted(d, NUMBERS), lambda d: P.dataset_health(d, NUMBERS), lambda d: P.validation_report(d),
    lambda d: K.business_kpis(d), lambda d: K.dynamic_kpis(d), lambda d: K.discovered_kpis(d, "day"), lambda d: G.correlation_pairs(d, ["revenue", "units"]),
    lambda d: TR.period_growth(d, "day", ["cost", "revenue"]), lambda d: TR.seasonality(d, "day", "revenue"), lambda d: A.zscore(d, NUMBERS),
    lambda d: G.segment_revenue_share(d, ["customer", "code"], "revenue", 10.0), lambda d: I.insight_battery(d, "day"),
])
def test_a_remembered_table_gives_the_same(table, section):
    plain = staged_table(table)
    assert same(section(B.remember(staged_table(table))), section(plain))


def test_previous_values_cross_buckets(spark):
    rows = [(d, k, None if (d + k) % 3 == 0 or d == 2 else float(10 * d + k)) for d in range(6) for k in range(4)]
    found = bucketed_previous(spark.createDataFrame(rows, "d int, k int, v double"), ["v"], ["d", "k"], F.col("d"))
    want, last = {}, None
    for d, k, v in rows:
        want[d, k] = last
        last = v if v is not None else last
    assert {(r.d, r.k): r.prev_v for r in found.collect()} == want


def test_shared_jobs_run_once(table, monkeypatch):
    ran = []
    quantiles, values = B.exact_quantiles, B.per_value
    monkeypatch.setattr(B, "exact_quantiles", lambda df, columns, *rest: ran.append("quartiles") or quantiles(df, columns, *rest))
    monkeypatch.setattr(B, "per_value", lambda df, columns, aggs, keep=None: ran.append("values" if keep is None else "amounts") or values(df, columns, aggs, keep))
    result = run_analysis(table, "t", models=False)
    assert {n: s for n, s in result.status.items() if s != "ok"} == {}
    assert sorted(ran) == ["amounts", "quartiles", "values"]
