"""The whole battery: every stage ends well on whole data, and a stage that fails is named and hides no other."""

from __future__ import annotations

import pytest

from tallyforge.operators import forecast as FO
from tallyforge.plans.analysis import run_analysis, section_sizes
from tallyforge.queries.base import Tables

LAST = {"forecast_selection", "evidence_insights", "enriched_anomalies", "enriched_kpis", "root_causes", "executive_outputs"}


@pytest.fixture(scope="module")
def sales(spark):
    lines = Tables(spark, "/root/testdata/sf0.001").sales.where("order_id % 7 = 0")
    rows = lines.select("order_date", "customer_name", "category", "quantity", "revenue").toPandas()
    return spark.createDataFrame(rows)


def test_all_stages_end_well(spark, sales):
    result = run_analysis(sales.drop("customer_name"), "sales")
    assert {n: s for n, s in result.status.items() if s != "ok"} == {}
    assert LAST < result.sections.keys()
    sizes = {r.section: (r.rows, r.status) for r in section_sizes(spark, result).collect()}
    assert sizes.keys() == result.status.keys() and sizes["shape"] == (1, "ok") and sizes["executive_outputs"] == (1, "ok")
    assert all(sizes[n][0] > 0 for n in ("forecast_selection", "enriched_kpis"))


def test_a_failing_stage_is_named(spark, sales, monkeypatch):
    def broken(*args, **options):
        raise ValueError("no forecast today")

    monkeypatch.setattr(FO, "forecast", broken)
    found = section_sizes(spark, run_analysis(sales.select("order_date", "category", "revenue"), "sales", models=False)).collect()
    assert {r.section: (r.rows, r.status) for r in found if r.status != "ok"} == {"forecast": (None, "failed: no forecast today")}
