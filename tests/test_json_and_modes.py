"""JSON by records and by columns, and the wording of findings in further languages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.lookups import PHRASES
from tallyforge.operators import insight as I
from tallyforge.sources import read_json


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(folder / name)


def test_columns_become_rows(spark, tmp_path):
    keyed = {"id": {"0": 1, "1": 2, "7": None}, "name": {"0": "a", "1": "b\n{\"x\": 1}", "9": "only"}, "rate": {"0": 1.5, "1": 2}, "ok": {"0": True, "1": False}}
    got = read_json(spark, put(tmp_path, "keyed.json", keyed))
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("rate", "double"), ("ok", "boolean")]
    assert {tuple(r) for r in got.collect()} == {(1, "a", 1.5, True), (2, "b\n{\"x\": 1}", 2.0, False), (None, None, None, None), (None, "only", None, None)}
    lists = read_json(spark, put(tmp_path, "lists.json", {"b": [3, 3, None], "a b.c": ["x", "x", "z"], "none": [None, None, None]}))
    assert lists.dtypes == [("b", "bigint"), ("a b.c", "string"), ("none", "string")]
    assert sorted(map(tuple, lists.collect()), key=str) == sorted([(3, "x", None), (3, "x", None), (None, "z", None)], key=str)


def test_records_stay_records(spark, tmp_path):
    assert [tuple(r) for r in read_json(spark, put(tmp_path, "one.json", {"a": 1, "b": {"c": 2}})).select("a", "b.c").collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in read_json(spark, put(tmp_path, "many.json", [{"a": 1}, {"a": 2}])).collect()) == [(1,), (2,)]
    assert sorted(r.value for r in read_json(spark, put(tmp_path, "bare.json", [1, 2, 3])).collect()) == ["1", "2", "3"]


def test_several_files_of_columns_and_mixed_kinds(spark, tmp_path):
    many = tmp_path / "many"
    many.mkdir()
    put(many, "a.json", {"x": {"0": 1}, "y": {"0": 2}})
    put(many, "b.json", {"x": {"0": 1}, "z": {"0": 3}})
    assert {tuple(r) for r in read_json(spark, str(many)).select("x", "y", "z").collect()} == {(1, 2, None), (1, None, 3)}
    put(many, "c.json", [{"x": 1}])
    with pytest.raises(ValueError):
        read_json(spark, str(many))


def findings(spark):
    rows = [("d", "Concentration risk in Anomalies detected.", "Opportunity.", "Investigate it", [("kpi", 2.0), (None, None)]),
            ("e", "Missing data (some). More.", None, None, [])]
    return spark.createDataFrame(rows, "dataset_id string, observation string, impact string, recommendation string, evidence array<struct<kpi:string,value:double>>")


def test_modes_in_every_language(spark):
    got = {r.dataset_id: r for r in I.localize_modes(I.render_modes(I.with_reasoning(findings(spark)))).collect()}
    assert got["d"].reasoning == "Based on observed evidence: kpi: 2.0, : " and got["e"].reasoning == "Observation derived from dataset signals."
    for r in got.values():
        for mode in ("business", "data", "eli5"):
            for language, phrases in PHRASES.items():
                want = r[f"mode_{mode}"]
                for phrase, other in phrases.items():
                    want = want.replace(phrase, other)
                assert want and r[f"mode_{mode}_{language}"] == want
    assert "Recommended action (sifarish): Investigate (janch karein) it" in got["d"].mode_business_hinglish


def test_findings_recommend(spark):
    table = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("quantity"), F.when(F.col("id") > 3, F.col("id") * 2.0).alias("revenue"), F.lit("n").alias("region"))
    rows = I.insight_battery(table).collect()
    assert all(r.recommendation for r in rows if r.title != "Executive summary")
    assert any(r.recommendation == "Design promotions or analyses specifically around Revenue." for r in rows)
