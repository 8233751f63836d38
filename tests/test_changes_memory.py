"""Changes over time: the middle of a measure's rows is found without gathering its rows, and a label is one entry of a task."""

import datetime as dt

from tallyforge.plans import answers as A


def test_changes_group_nothing_by_measure(spark, monkeypatch):
    asked, quantiles = [], A.exact_quantiles
    monkeypatch.setattr(A, "exact_quantiles", lambda df, columns, probs, by=(): asked.append(list(by)) or quantiles(df, columns, probs, by))
    day = dt.datetime(2024, 1, 1)
    # u is known on the last six days alone, so its middle is later than that of v; one label is missing
    rows = [(day + dt.timedelta(days=i), "ab"[i % 2] if i != 3 else None, 1.0 + (i >= 6), 10.0 - i if i >= 6 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "t timestamp, g string, v double, u double")
    plans = spark.createDataFrame([("why_change", "g", m, 5, "why_change", "G", m.upper()) for m in "vu"] + [("why_change", None, "v", 5, "why_change", None, "V")],
                                  "intent string, dimension string, measure string, n int, kind string, d string, m string")
    found = {(r["dimension"], r["measure"]): (r["label"], r["value"]) for r in A._changes(df, plans, "t", ["u", "v"], ["g"]).collect()}
    assert found == {("g", "v"): ("b", 100.0), ("g", "u"): ("a", -100.0), (None, "v"): (None, 100.0)}
    assert asked and not any(asked)
    sums = {(r["label"], r["measure"]): r["amount"] for r in A._cells(df, ["g"], ["v"]).collect()}
    assert sums == {("a", None): 6.0, ("b", None): 5.0, ("a", "v"): 9.0, ("b", "v"): 8.0}
