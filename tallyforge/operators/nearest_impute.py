"""Nearest-neighbour imputation under missing coordinates, without comparing all pairs.

The distance of two rows is Euclidean over the columns that both have, scaled up by the share of columns compared. Equal rows are
combined first. Rows that can give a value are kept apart by which columns they have (their pattern); each pattern has a tree of axis
cuts for every set of columns that it shares with a pattern with holes, so every cut prunes: a tree with cuts along columns that a
row lacks would send it into a growing part of its leaves. A row with holes first looks into one leaf of every pattern, which bounds the
distance of its neighbours, and then into every leaf within that bound. The sample behind the trees decides the balance, never the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col
from tallyforge.session import checkpoint_frame

#: Rows behind all trees together, and rows that a leaf or a block of it should hold.
SAMPLE, LEAF_ROWS = 50000, 2000


def _vector(columns: list[str]) -> Column:
    """The columns as doubles; NaN and infinite values count as missing."""
    def number(c: str) -> Column:
        x = col(c).cast("double")
        return F.when(F.abs(x) < float("inf"), x + F.lit(0.0))

    return F.array(*[number(c) for c in columns])


def _name(v: Column) -> Column:
    """Two independent 64-bit hashes and the pattern name a vector; the name is stable under recomputation."""
    return F.concat_ws("-", F.xxhash64(v).cast("string"), F.xxhash64(F.lit(7), v).cast("string"), _pattern(v))


def _pattern(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")


def _shared(own: str, other: str) -> str | None:
    """The columns that rows of both patterns have, as a pattern; None where there are none or ``other`` fills no hole of ``own``."""
    both = "".join("1" if a == b == "1" else "0" for a, b in zip(own, other))
    return both if "1" in both and any(a == "0" and b == "1" for a, b in zip(own, other)) else None


def _grow_forest(points: DataFrame, leaf_rows: int) -> tuple[list, dict[str, dict[str, int]]]:
    """Nodes (axis, cut, left, right; axis -1: leaf), and by pattern the root of its tree for each set of columns it shares with rows that it can fill."""
    sizes = {r["pattern"]: r["count"] for r in points.groupBy("pattern").count().collect()}
    share = min(1.0, SAMPLE / max(sum(sizes.values()), 1))
    chosen = points.where(F.pmod(F.xxhash64("point_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else points
    sample = chosen.select("pattern", "v").toPandas()
    nodes: list[list] = []

    def grow(part: np.ndarray, axes: list[int], depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1])
        spread = np.ptp(part[:, axes], axis=0) if len(part) else np.zeros(1)
        if depth <= 0 or len(part) < 4 or spread.max() == 0:
            return at
        axis = axes[int(spread.argmax())]
        cut = float(np.median(part[:, axis]))
        low = part[:, axis] < cut
        if not low.any():
            return at
        nodes[at] = [axis, cut, grow(part[low], axes, depth - 1), grow(part[~low], axes, depth - 1)]
        return at

    roots: dict[str, dict[str, int]] = {}
    for pattern, size in sorted(sizes.items()):
        rows = sample["v"][sample["pattern"] == pattern].tolist()
        data = np.array(rows, dtype=float).reshape(len(rows), len(pattern))
        depth = int(np.ceil(np.log2(max(size / leaf_rows, 1))))
        sets = sorted({both for own in sizes if (both := _shared(own, pattern))})
        roots[pattern] = {both: grow(data, [i for i, bit in enumerate(both) if bit == "1"], depth) for both in sets}
    return nodes, roots


def _leaves(nodes: list, root: int, v: np.ndarray, radius: float | None) -> list[int]:
    """Leaves below ``root`` within ``radius`` of ``v``; without a radius the one that ``v`` falls into."""
    out, stack = [], [(root, {})]
    while stack:
        at, gaps = stack.pop()
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out.append(at)
            continue
        near, far = (left, right) if not v[axis] >= cut else (right, left)
        stack.append((near, gaps))
        if radius is not None:
            wider = gaps if np.isnan(v[axis]) else {**gaps, axis: max((v[axis] - cut) ** 2, gaps.get(axis, 0.0))}
            if sum(wider.values()) <= radius * radius * (1 + 1e-9):
                stack.append((far, wider))
    return out


def _visits(nodes: list, roots: dict[str, dict[str, int]], width: int):
    """Function (pattern, v, radius) -> leaves that can hold a neighbour; radius NULL: one leaf of each pattern."""
    @F.pandas_udf("array<int>")
    def visit(patterns: pd.Series, vs: pd.Series, radii: pd.Series) -> pd.Series:
        trees = {own: [(roots[other][both], both.count("1")) for other in roots if (both := _shared(own, other))] for own in patterns.unique()}
        found = []
        for own, v, radius in zip(patterns, vs, radii):
            point, leaves = np.array(v, dtype=float), []
            for root, shared in trees[own]:
                leaves += _leaves(nodes, root, point, None if pd.isna(radius) else radius / np.sqrt(width / shared))
            found.append(leaves)
        return pd.Series(found)

    return visit


def _nearest(q: pd.DataFrame, p: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each row and hole of ``q`` the donors of ``p`` that hold the k smallest (distance, value)."""
    a, b = np.array(q["v"].tolist(), dtype=float), np.array(p["v"].tolist(), dtype=float)
    width = a.shape[1]
    gap, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for axis in range(width):
        step = (a[:, axis][:, None] - b[:, axis][None, :]) ** 2
        both = ~np.isnan(step)
        gap += np.where(both, step, 0.0)
        shared += both
    with np.errstate(divide="ignore"):
        gap = np.where(shared > 0, np.sqrt(gap) * np.sqrt(width / shared), np.inf)
    ids, weights = q["point_id"].to_numpy(), p["weight"].to_numpy()
    found: list[tuple] = []
    for axis in range(width):
        rows, givers = np.flatnonzero(np.isnan(a[:, axis])), np.flatnonzero(~np.isnan(b[:, axis]))
        if not len(rows) or not len(givers):
            continue
        near, values = gap[np.ix_(rows, givers)], b[givers, axis]
        last = min(k, len(givers)) - 1
        bounds = np.partition(near, last, axis=1)[:, last]
        for row, gaps, bound in zip(rows, near, bounds):
            tied = np.flatnonzero((gaps <= bound) & (gaps < np.inf))
            best = tied[np.lexsort((values[tied], gaps[tied]))[:k]]
            found.append((np.full(len(best), row), np.full(len(best), axis, dtype=np.int32), gaps[best], values[best], weights[givers[best]]))
    if not found:
        return pd.DataFrame(columns=["point_id", "hole", "gap", "value", "weight"])
    row, hole, gaps, values, counts = (np.concatenate(part) for part in zip(*found))
    return pd.DataFrame({"point_id": ids[row], "hole": hole, "gap": gaps, "value": values, "weight": counts})


def _search(asked: DataFrame, stored: DataFrame, visit, k: int, chunk: int) -> DataFrame:
    """Candidates of every asked row from all leaves it visits, in blocks of about ``chunk`` rows of both sides."""
    visits = asked.withColumn("leaf", F.explode(visit("pattern", "v", "radius"))).select("leaf", "point_id", "v")
    parts = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    blocks = stored.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"))
    layout = parts.join(blocks, "leaf")
    place = lambda n, salt: F.pmod(F.xxhash64("point_id", F.lit(salt)), n).cast("int")
    left = visits.join(layout, "leaf").withColumn("part", place(F.col("parts"), 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = stored.join(layout, "leaf").withColumn("block", place(F.col("blocks"), 2)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["leaf", "part", "block"]
    # both sides descend from the same points; fresh aliases keep their columns apart
    left, right = (d.select(*[F.col(c).alias(c) for c in keys + names]) for d, names in ((left, ["point_id", "v"]), (right, ["v", "weight"])))

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return _nearest(q, p, k) if len(q) and len(p) else pd.DataFrame(columns=["point_id", "hole", "gap", "value", "weight"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compare, "point_id string, hole int, gap double, value double, weight long")
    ahead = F.sum("weight").over(W.partitionBy("point_id", "hole").orderBy("gap", "value").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < k)


def impute_nearest(df: DataFrame, columns: list[str], neighbours: int = 5, leaf_rows: int = LEAF_ROWS, chunk: int = LEAF_ROWS) -> DataFrame:
    """NULL -> mean of that column over the ``neighbours`` nearest rows that have it; other columns are kept.

    NULL, NaN and infinite values are missing; results are doubles. Rows at equal distance are taken by smallest value, repeated rows
    count each. A hole takes the column mean where no row with a value shares a column with its row, and stays NULL in a column without values.
    With fewer rows that can give a value, all of them count; an empty table stays empty.
    """
    spark, width = df.sparkSession, len(columns)
    tagged = df.select(*[col(c) for c in df.columns if c not in columns], _vector(columns).alias("_v"))
    grouped = tagged.groupBy(F.col("_v").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    points = checkpoint_frame(grouped.select(_name(F.col("v")).alias("point_id"), _pattern(F.col("v")).alias("pattern"), "v", "weight"))
    means = points.agg(F.sum("weight").alias("n"), *[
        (F.sum(F.get("v", F.lit(i)) * F.col("weight")) / F.sum(F.when(F.get("v", F.lit(i)).isNotNull(), F.col("weight")))).alias(f"m{i}") for i in range(width)]).first()
    k = min(neighbours, max(1, (means["n"] or 0) - 1))
    nodes, roots = _grow_forest(points, leaf_rows)
    shipped = spark.sparkContext.broadcast(nodes)

    @F.pandas_udf("array<int>")
    def own_leaves(patterns: pd.Series, vs: pd.Series) -> pd.Series:
        points = (np.array(v, dtype=float) for v in vs)
        return pd.Series([[_leaves(shipped.value, root, v, None)[0] for root in roots[p].values()] for p, v in zip(patterns, points)])

    full, none = "1" * width, "0" * width
    stored = checkpoint_frame(points.where(F.col("pattern") != none).withColumn("leaf", F.explode(own_leaves("pattern", "v"))))
    asked = points.where(~F.col("pattern").isin(full, none)).drop("weight")
    visit = _visits(nodes, roots, width)
    first = _search(asked.withColumn("radius", F.lit(None).cast("double")), stored, visit, k, chunk)
    # a hole of few candidates has no bound yet; the widest hole of a row decides
    held = first.groupBy("point_id", "hole").agg(F.max("gap").alias("gap"), F.sum("weight").alias("got"))
    bound = held.groupBy("point_id").agg(F.max(F.when(F.col("got") >= k, F.col("gap")).otherwise(1e300)).alias("radius"), F.count(F.lit(1)).alias("holes"))
    fillable = [i for i in range(width) if means[f"m{i}"] is not None]
    wanted = sum((F.get("v", F.lit(i)).isNull().cast("int") for i in fillable), F.lit(0))
    reach = F.when(F.col("holes") == wanted, F.col("radius")).otherwise(1e300)
    bounded = asked.join(bound, "point_id", "left").withColumn("radius", F.coalesce(reach, F.lit(1e300))).drop("holes")
    near = _search(bounded, stored, visit, k, chunk)
    use = F.least(F.col("weight"), F.lit(k) - F.col("ahead"))
    filled = near.groupBy("point_id", "hole").agg((F.sum(F.col("value") * use) / F.sum(use)).alias("value"))
    fills = filled.groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("hole", "value"))).alias("_fill"))
    holed = F.exists("_v", lambda x: x.isNull())
    mended = tagged.where(holed).withColumn("_id", _name(F.col("_v"))).join(fills.withColumnRenamed("point_id", "_id"), "_id", "left")
    rest = [col(c) for c in df.columns if c not in columns]
    at = lambda i: F.get("_v", F.lit(i))
    whole = tagged.where(~holed).select(*rest, *[at(i).alias(c) for i, c in enumerate(columns)])
    done = mended.select(*rest, *[
        F.coalesce(at(i), F.element_at("_fill", F.lit(i)), F.lit(means[f"m{i}"]).cast("double")).alias(c) for i, c in enumerate(columns)])
    return whole.unionByName(done).select(*[col(c) for c in df.columns])
