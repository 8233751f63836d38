"""Near duplicates of embeddings by a forest of random-projection trees with spill.

1. Equal vectors form a class and are compared once.
2. ``trees`` coarse trees are grown on a bounded sample (``sample`` vectors): a node splits at the median of the projections on a
   random direction. Every class goes down each tree; where its projection is within ``spill`` of the median it goes
   both ways, so close vectors on either side of a cut still meet.
3. A coarse leaf above ``group`` vectors is split again, in rounds over all such leaves at once: three directions of its own, cuts at the
   medians that its own vectors have there, spill as before. A leaf that does not part (a dense spot) stays and is compared in pairs of blocks,
   which is exact. So the forest is as deep as the table needs, whatever the sample.
4. The vectors of a leaf meet in one task, which goes on splitting in the same way down to ``leaf`` vectors and
   compares all vectors of a leaf in double precision. Where splitting does not part them they are compared
   directly, in row blocks. Links found are reduced to a spanning forest per task, so rows stay linear.
5. Links of all trees are united; in every component all pairs are verified again, in blocks, which gives the exact
   number of links inside it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import in_blocks, whole_runs
from tallyforge.session import checkpoint_frame


class Tree:
    """A coarse tree: directions, cuts and children of its nodes; leaves are numbered."""

    def __init__(self, x: np.ndarray, least: int, seed: int):
        rng = np.random.default_rng(seed)
        self.direction, self.cut, self.child, self.leaves = [], [], [], 0
        self._grow(np.arange(len(x)), x, max(least, 2), rng)

    def _grow(self, rows: np.ndarray, x: np.ndarray, least: int, rng) -> int:
        """The index of the node, or -1 - leaf."""
        if len(rows) > least:
            way = rng.standard_normal(x.shape[1])
            way /= np.linalg.norm(way)
            p = x[rows] @ way
            cut = float(np.median(p))
            left, right = rows[p < cut], rows[p >= cut]
            if len(left) and len(right):
                node = len(self.cut)
                self.direction.append(way)
                self.cut.append(cut)
                self.child.append(None)
                a = self._grow(left, x, least, rng)
                self.child[node] = (a, self._grow(right, x, least, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray, spill: float) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for every leaf that rows of ``x`` reach."""
        if not self.cut:
            return [(0, np.arange(len(x)))]
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-node - 1, rows))
                continue
            p = x[rows] @ self.direction[node] - self.cut[node]
            a, b = self.child[node]
            todo += [(a, rows[p < spill]), (b, rows[p >= -spill])]
        return out


def _links(x: np.ndarray, dim: np.ndarray, threshold: float, label: np.ndarray, rows: np.ndarray, step: int = 512, others: np.ndarray | None = None) -> None:
    """Give one label (the smallest) to all pairs of ``rows``, or of rows and ``others``, whose cosine reaches the threshold."""
    for a in range(0, len(rows), step):
        part = rows[a:a + step]
        right = rows[a:] if others is None else others
        near = (x[part] @ x[right].T >= threshold) & (dim[part][:, None] == dim[right][None, :])
        for i in np.flatnonzero(near.any(1)):
            found = label[right[near[i]]]
            low, high = min(found.min(), label[part[i]]), max(found.max(), label[part[i]])
            if low != high:
                label[np.isin(label, np.append(found, label[part[i]]))] = low


def _descend(x: np.ndarray, dim: np.ndarray, threshold: float, spill: float, leaf: int, seed: int) -> np.ndarray:
    """Smallest row linked with each row by the links that one more tree over ``x`` finds."""
    label = np.arange(len(x))
    rng, todo = np.random.default_rng(seed), [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            _links(x, dim, threshold, label, rows)
            continue
        way = rng.standard_normal(x.shape[1])
        p = x[rows] @ (way / np.linalg.norm(way))
        cut = np.median(p)
        left, right = rows[p < cut + spill], rows[p >= cut - spill]
        if max(len(left), len(right)) > 0.75 * len(rows):
            _links(x, dim, threshold, label, rows)
        else:
            todo += [left, right]
    return label


def _unit(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision, padded with zeros to ``width``."""
    flat = np.frombuffer(b"".join(batch.column(name).to_pylist()), "<f8").reshape(-1, width) if batch.num_rows else np.zeros((0, width))
    return flat / np.linalg.norm(flat, axis=1, keepdims=True) if len(flat) else flat


def _bounded_leaves(entries: DataFrame, width: int, margin: float, group: int, seed: int) -> DataFrame:
    """``entries`` (leaf, rep, dim, x) with ``members``: leaves above ``group`` are split until they fit or do not part; leaves of one vector are left out.

    A split has eight children. It counts where the largest child holds at most half of the leaf, so the number of rounds is logarithmic;
    otherwise the leaf stays whole.
    """
    done, going, ways = [], entries, 3

    def project(batches):
        for batch in batches:
            x, leaves = _unit(batch, "x", width), batch.column("leaf").to_numpy()
            p = np.zeros((len(x), ways))
            for one in np.unique(leaves):
                at = leaves == one
                way = np.random.default_rng([seed, int(one)]).standard_normal((width, ways))
                p[at] = x[at] @ (way / np.linalg.norm(way, axis=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, k]) for k in range(ways)]], [*batch.schema.names, *[f"p{k}" for k in range(ways)]])

    while True:
        counts = checkpoint_frame(going.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
        large = counts.where(F.col("members") > group)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done, going.join(counts, "leaf"))
        done.append(going.join(counts.where(F.col("members") <= group), "leaf"))
        cast = going.join(large, "leaf").select("leaf", "rep", "dim", "x", "members").mapInArrow(
            project, "leaf long, rep long, dim int, x binary, members long, " + ", ".join(f"p{k} double" for k in range(ways)))
        cuts = cast.groupBy("leaf").agg(*[F.percentile_approx(f"p{k}", 0.5, 1000).alias(f"cut{k}") for k in range(ways)])
        below = [F.col(f"p{k}") < F.col(f"cut{k}") + margin for k in range(ways)]
        above = [F.col(f"p{k}") >= F.col(f"cut{k}") - margin for k in range(ways)]
        reached = [F.when(reduce(lambda a, b: a & b, [above[k] if code >> k & 1 else below[k] for k in range(ways)]), F.lit(code)) for code in range(1 << ways)]
        coded = checkpoint_frame(cast.join(cuts, "leaf").select("leaf", "rep", "dim", "x", "members", F.array_compact(F.array(*reached)).alias("codes")))
        children = coded.select("leaf", "members", F.explode("codes").alias("code")).groupBy("leaf", "members", "code").agg(F.count(F.lit(1)).alias("n"))
        parted = children.groupBy("leaf", "members").agg((2 * F.max("n") <= F.col("members")).alias("parted")).where("parted").select("leaf")
        parted = checkpoint_frame(parted)
        done.append(coded.drop("codes").join(parted, "leaf", "left_anti"))
        going = checkpoint_frame(coded.join(parted, "leaf").select("leaf", "rep", "dim", "x", F.explode("codes").alias("code")).select(
            F.shiftrightunsigned(F.xxhash64("leaf", "code"), 1).alias("leaf"), "rep", "dim", "x"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int = 8, spill: float = 0.2, leaf: int = 512, group: int = 8192,
                 coarse: int = 2048, sample: int = 8192, seed: int = 11) -> DataFrame:
    """One row per distinct (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts other vectors of cosine at least ``threshold`` (all vectors of a component are compared); component_id is the
    smallest id reachable; kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Vectors of different lengths do not link. ``spill`` is in units of one over the root of
    the length. Repeated rows count once; other columns are ignored; an empty table gives no rows. Rows of null id link as
    others do; a class without any id is named by a negative number made from its vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))  # no square: it would overflow or vanish
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
    usable = fine & F.coalesce(largest > 0, F.lit(False))
    # -0.0 and 0.0 are one number
    clean = F.when(usable, F.transform("v", lambda x: x + 0.0))
    table = checkpoint_frame(rows.select("vec_id", clean.alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))))
    one = table.where("key IS NOT NULL").groupBy("key", "vec_id").agg(F.first("v").alias("v"))
    classes = one.groupBy("key").agg(F.min("vec_id").alias("id0"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    width = table.agg(F.max(F.size("v"))).first()[0] or 1

    def pack(batches):
        for batch in batches:
            got = []
            for v in batch.column("v").to_pylist():
                x = np.zeros(width)
                x[:len(v)] = v
                m = np.abs(x).max()
                got.append((x / m).astype("<f8").tobytes())
            dim = pa.array([len(v) for v in batch.column("v").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rep"), batch.column("n"), dim, pa.array(got, pa.binary())], ["key", "rep", "n", "dim", "x"])

    classes = checkpoint_frame(classes.select("key", F.coalesce("id0", -F.abs(F.shiftright(F.xxhash64("key"), 1)) - 1).alias("rep"), "n", "v")
                               .mapInArrow(pack, "key string, rep long, n long, dim int, x binary"))
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("key"), "key").limit(sample).select("x").toArrow()
    base = _unit(picked.combine_chunks().to_batches()[0], "x", width) if picked.num_rows else np.zeros((0, width))
    least = max(16, int(coarse * len(base) / max(total, 1)))
    shared = table.sparkSession.sparkContext.broadcast([Tree(base, least, seed + t) for t in range(trees)])
    margin = spill / np.sqrt(width)

    def route(batches):
        for batch in batches:
            x = _unit(batch, "x", width)
            for t, tree in enumerate(shared.value):
                for place, at in tree.route(x, margin):
                    take = batch.select(["rep", "dim", "x"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t * (1 << 32) + place, np.int64)), *take.columns], ["leaf", "rep", "dim", "x"])

    entries = checkpoint_frame(classes.mapInArrow(route, "leaf long, rep long, dim int, x binary"))
    met = in_blocks(_bounded_leaves(entries, width, margin, group, seed), "leaf", F.when(F.col("members") > group, F.ceil(F.col("members") / (group / 2))).otherwise(F.lit(1)), "rep").drop("members")

    def compare(batches):
        for tab, bounds in whole_runs(batches, ["leaf", "lo", "hi"]):
            rep, dim, lo, hi, own, tree = (tab.column(c).to_numpy() for c in ("rep", "dim", "lo", "hi", "own", "leaf"))
            left, right = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                x = _unit(tab.slice(a, b - a).combine_chunks().to_batches()[0], "x", width)
                if lo[a] == hi[a]:
                    roots = _descend(x, dim[a:b], threshold, margin, leaf, seed + 1000 + int(tree[a] % 1000))
                else:
                    roots = np.arange(b - a)
                    _links(x, dim[a:b], threshold, roots, np.flatnonzero(own[a:b] == lo[a]), others=np.flatnonzero(own[a:b] == hi[a]))
                moved = np.flatnonzero(roots != np.arange(b - a))
                left.append(rep[a:b][moved])
                right.append(rep[a:b][roots[moved]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    found = components(met.mapInArrow(compare, "a long, b long"))
    members = checkpoint_frame(found.withColumnRenamed("node", "rep").join(classes.select("rep", "n", "dim", "x"), "rep"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    pairs = in_blocks(members.join(sizes, "component"), "component", F.ceil(F.col("k") / (group / 4)), "rep").drop("k")

    def verify(batches):
        for tab, bounds in whole_runs(batches, ["component", "lo", "hi"]):
            rep, n, dim, lo, hi, own = (tab.column(c).to_numpy() for c in ("rep", "n", "dim", "lo", "hi", "own"))
            count = np.zeros(len(rep), np.int64)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                x = _unit(tab.slice(a, b - a).combine_chunks().to_batches()[0], "x", width)
                for c in range(0, b - a, 512):
                    end = min(c + 512, b - a)
                    near = (x[c:end] @ x.T >= threshold) & (dim[a + c:a + end, None] == dim[None, a:b])
                    near[np.arange(end - c), np.arange(c, end)] = False
                    if lo[a] != hi[a]:
                        near &= own[a + c:a + end, None] != own[None, a:b]
                    count[a + c:a + end] = near @ n[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(count)], ["rep", "links"])

    links = pairs.mapInArrow(verify, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("key", "rep", "n").join(links, "rep", "left").join(members.select("rep", "component"), "rep", "left")
    return (
        table.select("vec_id", "key").distinct().join(named, "key", "left")
        .select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
