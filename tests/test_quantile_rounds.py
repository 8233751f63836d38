"""Quantiles by rounds against numpy: ties, heavy tails, nulls, single values and groups of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import quantile


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    heavy = np.exp(rng.normal(0, 6, 6000))
    rows = [("heavy", float(v), float(k % 11)) for k, v in enumerate(heavy)]
    rows += [("ties", float(v), None) for v in rng.integers(0, 5, 3000)]
    rows += [("one", 7.0, 1.0), ("none", None, None), (None, 2.0, 3.0), (None, 4.0, None)]
    rows += [("lines", float(v), -float(v)) for v in range(4000)]
    return rows, spark.createDataFrame(rows, "g string, v double, w double").withColumn("range", F.lit(1)).repartition(7)


@pytest.mark.parametrize("rows", [100, 700, quantile.ROWS])
def test_groups_equal_numpy(table, rows):
    values, df = table
    probs = [0.75, 0.0, 0.25, 0.5, 1.0, 0.99]
    got = {(r.g, r.column): (r.n, r.q) for r in quantile.exact_quantiles(df, ["v", "w"], probs, ["g"], rows).collect()}
    want = {}
    for g, v, w in values:
        for c, x in (("v", v), ("w", w)):
            if x is not None and g is not None:  # as in pandas, rows of a null group are left out
                want.setdefault((g, c), []).append(x)
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert got[key][0] == len(x) and got[key][1] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)


def test_a_round_leaves_few_rows(spark):
    """Only ranges with a wanted rank keep their values, however the values lie."""
    spread = spark.range(20_000).select(F.lit("c").alias("column"), F.lit(20_000).cast("long").alias("n"), F.lit(1).cast("long").alias("rows"),
                                        F.exp(F.col("id") / 40).alias("lo"), F.exp(F.col("id") / 40).alias("hi"))
    left = quantile._narrowed(spread, ["column"], [0.5], 1000).collect()
    assert len(left) <= 1000 and sum(r.rows for r in left) == 20_000
    at = sorted((r.lo, r.hi, r.rows) for r in left)
    assert all(a[1] < b[0] for a, b in zip(at, at[1:], strict=False))
    assert quantile.exact_quantiles(spark.createDataFrame([], "v double"), ["v"], [0.5]).count() == 0
