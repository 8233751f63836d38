"""Neighbour search in numeric vectors without comparing all pairs.

Identical vectors are combined first (with a weight). A small tree of axis cuts,
built from a bounded sample chosen by hash, splits space into leaves of similar
size. A query visits only the leaves its ball can touch, so the work follows the
neighbours and not the square of the rows. Leaves still larger than ``chunk`` are
cut into blocks, so one dense region is searched by many tasks. Results are exact:
the sample decides the balance, never the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 100000


def distinct_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """(point_id, v ARRAY<DOUBLE>, weight): each different vector once."""
    v = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in columns])
    grouped = df.select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("weight"))
    # Two independent 64-bit hashes name a vector; the name is stable under recomputation.
    name = F.concat_ws("-", F.xxhash64("v").cast("string"), F.hash("v").cast("string"), F.xxhash64("v", F.lit(7)).cast("string"))
    return grouped.select(name.alias("point_id"), "v", "weight")


def build_tree(points: DataFrame, leaf_rows: int = 2000) -> dict:
    """Axis cuts from at most SAMPLE hashed points; leaves hold about ``leaf_rows`` points of the full data."""
    total = points.count()
    sample = points.orderBy(F.xxhash64("point_id")).limit(SAMPLE).select("v").toPandas()["v"].tolist()
    data = np.array(sample, dtype=float)
    depth = int(np.ceil(np.log2(max(total / leaf_rows, 1))))
    nodes: list[list] = []

    def grow(part: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1])
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(1)
        if level == 0 or len(part) < 4 or spread.max() == 0:
            return at
        axis = int(spread.argmax())
        cut = float(np.median(part[:, axis]))
        left, right = part[part[:, axis] < cut], part[part[:, axis] >= cut]
        if not len(left):
            return at
        nodes[at] = [axis, cut, grow(left, level - 1), grow(right, level - 1)]
        return at

    if len(data):
        grow(data, depth)
    return {"nodes": nodes or [[-1, 0.0, -1, -1]]}


def _touch(nodes: list, v: np.ndarray, r: float) -> list[int]:
    """Leaves that the ball round ``v`` can touch."""
    out, stack = [], [(0, 0.0, {})]
    while stack:
        at, gap, offsets = stack.pop()
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out.append(at)
            continue
        near, far = (left, right) if v[axis] < cut else (right, left)
        stack.append((near, gap, offsets))
        d = (v[axis] - cut) ** 2
        wider = gap - offsets.get(axis, 0.0) + max(d, offsets.get(axis, 0.0))
        if wider <= r * r * (1 + 1e-12) + 1e-300:
            stack.append((far, wider, {**offsets, axis: max(d, offsets.get(axis, 0.0))}))
    return out


def leaves_within(tree: dict, vector: Column, radius: Column) -> Column:
    """Array of leaf numbers within ``radius`` of each vector (0: its own leaf)."""
    nodes = tree["nodes"]

    @F.pandas_udf("array<int>")
    def visit(vs: pd.Series, rs: pd.Series) -> pd.Series:
        return pd.Series([_touch(nodes, np.asarray(v), float(r)) for v, r in zip(vs, rs)])

    return visit(vector, radius)


def _blocks(points: DataFrame, tree: dict, chunk: int) -> DataFrame:
    """Points with their leaf and a block number that keeps every block near ``chunk`` rows."""
    placed = points.withColumn("leaf", leaves_within(tree, F.col("v"), F.lit(0.0))[0])
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("point_id", F.lit(1)), F.col("blocks")).cast("int")
    return placed.join(sizes, "leaf").withColumn("block", spread)


def search(
    queries: DataFrame, points: DataFrame, tree: dict, keep, schema: str, chunk: int = 2000
) -> DataFrame:
    """Run ``keep(distances, query rows, point rows)`` for every query block against every leaf block it can touch.

    ``queries``: point_id, v, radius and anything else. Both sides arrive in bounded
    blocks: points by leaf block, queries by hash within a visited leaf.
    """
    stored = _blocks(points, tree, chunk).select("leaf", "block", "blocks", "point_id", "v", *[c for c in points.columns if c not in ("point_id", "v")])
    layout = stored.groupBy("leaf").agg(F.max("blocks").alias("blocks"))
    visits = queries.withColumn("leaf", F.explode(leaves_within(tree, F.col("v"), F.col("radius")))).join(layout, "leaf")
    per_leaf = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    spread = visits.join(per_leaf, "leaf").withColumn("part", F.pmod(F.xxhash64("point_id", F.lit(2)), F.col("parts")).cast("int"))
    left = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = stored.join(per_leaf, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])
        a, b = np.array(q["v"].tolist()), np.array(p["v"].tolist())
        gap = np.zeros((len(a), len(b)))
        for axis in range(a.shape[1]):
            gap += (a[:, axis][:, None] - b[:, axis][None, :]) ** 2
        return keep(np.sqrt(gap), q, p)

    # Both sides descend from the same points; fresh aliases keep their columns apart.
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    keys = ["leaf", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
