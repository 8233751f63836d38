"""Wide tables, workbooks with different headers, and a run whose stages can fail."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.semantics import confidence_percent
from tallyforge.operators import anomaly as A, grouped as G, multivariate as M, profile as P, trend as TR
from tallyforge.plans.analysis import Analysis, _ordered
from tallyforge.sources import readers as R


@pytest.fixture(scope="module")
def wide(spark):
    """65 columns; a row that is odd from the 13th column on, and nulls in the last ones."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 65))
    x[:, 1] += 0.8 * x[:, 0]
    x[7, 12:20] = 1e6 * np.arange(1, 9)
    frame = pd.DataFrame(x, columns=[f"c{k}" for k in range(65)])
    for k in range(40, 65):
        frame.loc[rng.random(300) < 0.4, f"c{k}"] = None
    frame.insert(0, "key", range(300))
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "key long, " + ", ".join(f"c{k} double" for k in range(65)))


def test_correlations_skip_nulls_by_pair_at_any_width(wide):
    frame, df = wide
    names = [f"c{k}" for k in range(65)]
    got = {(r.col_a, r.col_b): r["corr"] for r in G.correlation_pairs(df, names).collect()}
    want = frame[names].corr()
    assert len(got) == 65 * 64 // 2
    assert all(abs(v - want.loc[a, b]) < 1e-9 for (a, b), v in got.items())
    few = {(r.col_a, r.col_b): r["corr"] for r in G.correlation_pairs(df, names[:60]).collect()}
    assert all(abs(few[p] - got[p]) < 1e-12 for p in few)


def test_every_column_is_searched_for_outliers(wide):
    _, df = wide
    names = [f"c{k}" for k in range(20)]
    assert M.isolation_scores(df, "key", names).orderBy(F.desc("score")).first()["key"] == 7
    assert "c12" in {r["column"] for r in A.row_zscore(df, names, top=1).collect()}
    assert P.distribution(df).count() == 66


def test_top_n_gives_what_is_asked_for(spark):
    df = spark.range(200).select(F.concat(F.lit("p"), "id").alias("label"), F.col("id").cast("double").alias("amount"))
    assert G.top_n(df, "label", "amount", 100).count() == 100


def test_confidence_rounds_halves_to_even(spark):
    row = spark.range(1).select(confidence_percent(F.array(F.lit(1.0), F.lit(0.13))).alias("x")).first()
    assert row.x == round((1.0 + 0.13) / 2 * 100) == 56


def test_invalid_numbers_lower_the_health_score(spark):
    good = spark.range(100).select(F.col("id").alias("n"), F.col("id").cast("string").alias("t"))
    bad = good.withColumn("t", F.when(F.col("n") < 10, "none").otherwise(F.col("t")))
    a, b = (P.health_score_weighted(x).first() for x in (good, bad))
    assert a.invalid_penalty == 0 and b.invalid_penalty == pytest.approx(10 / 200) and b.health_score < a.health_score


def workbook(rows, sheets=("first",), dates=False) -> bytes:
    """A workbook with shared strings and numbers; the first listed sheet is stored in the last file."""
    texts, body = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                texts.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}" s="{int(dates and r > 1 and c == 1)}"><v>{v}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        listed = "".join(f'<sheet name="{s}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets))
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{link}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{k}" Target="worksheets/sheet{len(sheets) - k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k in range(len(sheets)):
            inner = "".join(body) if k == 0 else '<row r="1"><c r="A1" t="inlineStr"><is><t>wrong</t></is></c></row>'
            book.writestr(f"xl/worksheets/sheet{len(sheets) - k}.xml", f"<worksheet {ns}><sheetData>{inner}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return out.getvalue()


def test_workbooks_keep_all_headers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", "name"], [1, "x"]], sheets=("first", "second")))
    (tmp_path / "b.xlsx").write_bytes(workbook([["id", "day", "amount"], [2, 43831, 2.5], [3, 43831.5, None]], dates=True))
    got = R.read_excel_folder(spark, str(tmp_path)).drop("source_file")
    assert got.columns == ["id", "name", "day", "amount"]
    assert sorted(map(tuple, got.collect())) == [("1", "x", None, None), ("2", None, "2020-01-01", "2.5"), ("3", None, "2020-01-01 12:00:00", None)]


def test_a_failing_section_is_reported(spark):
    run = Analysis("d")
    run.add("good", lambda: spark.range(3))
    run.add("bad", lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert run.status["good"] == "ok" and run.status["bad"].startswith("failed") and "bad" not in run.sections


def test_order_by_a_number_and_partitioning_do_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k // 3), float(v)) for k, v in enumerate(rng.lognormal(size=600))]
    df = spark.createDataFrame(rows, "order_id long, amount double")
    found = set()
    for parts in (1, 3, 7):
        keyed, order, bucket = _ordered(df.repartition(parts), ["order_id"])
        found.add(tuple(map(str, TR.pct_change_spikes(keyed, ["amount"], order, bucket).collect())))
        found.add(tuple(map(str, A.rule_anomalies(keyed, order, bucket, ["amount"]).collect())))
    assert len(found) == 2
