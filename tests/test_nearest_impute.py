"""Nearest-neighbour imputation against a plain loop over all pairs, and odd tables."""

from __future__ import annotations

import math
import random

from tallyforge.operators.nearest_impute import impute_nearest

SCHEMA = "id long, a double, b double, c double, note string"


def plain(rows, k=5):
    """Every hole by sorting all donors."""
    k, points = min(k, max(1, len(rows) - 1)), [tuple(None if x is None or not math.isfinite(x) else x for x in r[1:4]) for r in rows]
    means = []
    for c in range(3):
        known = [p[c] for p in points if p[c] is not None]
        means.append(sum(known) / len(known) if known else None)
    out = {}
    for row, p in zip(rows, points):
        filled = list(p)
        for c in range(3):
            if p[c] is None:
                near = []
                for q in points:
                    both = [i for i in range(3) if p[i] is not None and q[i] is not None]
                    if q[c] is not None and both:
                        gap = 0.0
                        for i in both:
                            gap += (p[i] - q[i]) ** 2
                        near.append((math.sqrt(gap) * math.sqrt(3 / len(both)), q[c]))
                best = sorted(near)[:k]
                filled[c] = sum(v for _, v in best) / len(best) if best else means[c]
        out[row[0]] = filled
    return out


def same(spark, rows, **options):
    got = {r.id: r for r in impute_nearest(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], **options).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, values in want.items():
        for c, value in zip("abc", values):
            assert (got[i][c] is None) == (value is None) and (value is None or math.isclose(got[i][c], value, rel_tol=1e-9, abs_tol=1e-12)), (i, c)
    return got


def test_equals_all_pairs_over_many_leaves_and_blocks(spark):
    draw = random.Random(5)

    def value(scale):
        return None if draw.random() < 0.25 else round(draw.gauss(0, scale), 1)

    rows = [(i, value(3), value(30), value(1), f"n{i}") for i in range(600)]
    rows += [(600 + i, 1.0, None, 2.0, None) for i in range(200)]  # one vector holds a quarter of all rows
    got = same(spark, rows, leaf_rows=20, chunk=15)
    assert got[7].note == "n7"


def test_missing_values_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    same(spark, [(1, 1.0, None, 2.0, ""), (2, nan, 5.0, 2.0, ""), (3, 3.0, 7.0, inf, ""), (4, None, None, None, None), (5, None, 1.0, None, "x")])
    same(spark, [(1, 1.0, None, None, ""), (2, 2.0, None, 4.0, ""), (3, None, None, None, "")])  # a column without values stays NULL
    same(spark, [(1, None, 2.0, None, "")])


def test_empty_and_complete_tables_and_other_columns(spark):
    empty = impute_nearest(spark.createDataFrame([], SCHEMA), ["a", "b", "c"])
    assert empty.count() == 0 and empty.columns == ["id", "a", "b", "c", "note"]
    complete = spark.createDataFrame([(1, 2, 3.0)], "hole int, `x y` int, value double")
    assert [tuple(r) for r in impute_nearest(complete, ["x y", "value"]).collect()] == [(1, 2.0, 3.0)]
