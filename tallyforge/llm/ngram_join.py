"""Similarity join of documents on word n-gram sets: MinHash bands propose, full sets verify.

Words are those of ``rolling``; a text of fewer than n words, but not none, is one gram; texts without words (also null)
link with nothing. Documents of equal gram sets form a class and are compared once, so any number of exact copies costs one row.

1. One pass computes the gram set's digest and MinHash values; classes are counted with map-side combination.
2. Band hashes are shuffled; only buckets of two classes or more go on. A bucket above ``block`` members is cut into blocks
   by hash and compared block against block, so no bucket is one task. Inside a block pair, classes whose sizes and MinHash
   values cannot belong to similar sets are left (the chance that a true pair is left is below ``miss``), and the rest is
   reduced to a spanning forest: rows stay linear in the members.
3. Each connected group of candidates is brought together with its full gram sets, again in blocks, and all its
   pairs are verified exactly. Links are counted per class in the task; pairs are never written out.
4. Verified links give the components.

Band and row counts follow from the threshold and the target recall (``plan_bands``).
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.components import components
from tallyforge.llm.rolling import batch_pieces, mix
from tallyforge.llm.shared import Bitmap, in_blocks, root_of, whole_runs
from tallyforge.session import checkpoint_frame


def plan_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """Fewest bands of ``rows`` values by which a pair at the threshold shares one with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def least_agreement(threshold: float, size: int, miss: float = 1e-6) -> int:
    """Number of equal MinHash values that a pair at the threshold falls short of with a chance below ``miss``."""
    tail = 0.0
    for k in range(size + 1):
        tail += math.comb(size, k) * threshold**k * (1 - threshold) ** (size - k)
        if tail >= miss:
            return k
    return size


def _minhash(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """16-bit MinHash values (texts x size) of gram hashes that lie text after text."""
    rng = np.random.default_rng(99)
    a, b = rng.integers(0, 2**32, size=(2, size), dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), size), np.uint16)
    for j in range(size):
        low = np.minimum.reduceat(x * (a[j] | np.uint32(1)) + b[j], starts)
        out[:, j] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _sets(words, n: int):
    """(texts, gram sets one after the other, bounds) of the texts of a piece that have words; each set sorted."""
    gram, at = words.grams(n)
    short, sdoc = words.short_grams(n)
    doc = np.concatenate([words.doc()[at], sdoc]) if len(at) else sdoc
    gram = np.concatenate([gram, short])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])) if len(doc) else np.zeros(0, bool)
    doc, gram = doc[new], gram[new]
    texts = np.unique(doc)
    return texts, gram, np.append(np.searchsorted(doc, texts), len(doc)).astype(np.int64)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """(doc_id, grams, digest, sig) of every row; digest and sig are null for texts without words."""
    def add(batches):
        for batch in batches:
            rows = batch.num_rows
            count, digest, sig = np.zeros(rows, np.int32), [None] * rows, [None] * rows
            for i, _, words in batch_pieces(batch.column(1)):
                texts, gram, cut = _sets(words, n)
                if not len(texts):
                    continue
                low = _minhash(gram, cut[:-1], size)
                count[i + texts] = np.diff(cut)
                for k, t in enumerate(texts):
                    digest[i + t], sig[i + t] = _digest(gram[cut[k]:cut[k + 1]]), low[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "grams", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(add, "doc_id long, grams int, digest binary, sig binary")


def _forest(batches, least: int, share: float):
    """Links (a, b) of a spanning forest of the members of each block pair whose sizes and MinHash values agree enough."""
    for table, bounds in whole_runs(batches, ["bucket", "lo", "hi"]):
        rep, m = table.column("rep").to_numpy(), table.column("grams").to_numpy().astype(np.float64)
        lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(rep), -1)
        left, right = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            cross = lo[a] != hi[a]
            parent = list(range(b - a))
            for i in range(a, b - 1):
                if cross and own[i] != lo[a]:
                    continue
                near = (sig[i + 1:b] == sig[i]).sum(1) >= least if not cross else (sig[a:b] == sig[i]).sum(1) >= least
                base = i + 1 if not cross else a
                sizes = m[base:b]
                near &= np.minimum(sizes, m[i]) >= share * np.maximum(sizes, m[i])
                if cross:
                    near &= own[a:b] == hi[a]
                for j in np.flatnonzero(near) + base:
                    x, y = root_of(parent, i - a), root_of(parent, int(j) - a)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            for k in range(b - a):
                r = root_of(parent, k)
                if r != k:
                    left.append(rep[a + k])
                    right.append(rep[a + r])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def common(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; elements of a single set are left out before counting."""
    size = len(sets)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(size), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.append(True, value[1:] != value[:-1])
    term = np.cumsum(new) - 1
    shared = np.bincount(term)[term] > 1
    term, row = term[shared], row[shared]
    out = np.zeros((size, size), np.float32)
    if not len(term):
        return out.astype(np.int64)
    term = np.cumsum(np.append(False, term[1:] != term[:-1]))
    cut = np.searchsorted(term, np.arange(0, term[-1] + chunk + 1, chunk))
    total = np.zeros((size, size), np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a < b:
            x = np.zeros((size, int(term[b - 1] - term[a]) + 1), np.float32)
            x[row[a:b], term[a:b] - term[a]] = 1
            total += np.rint(x @ x.T).astype(np.int64)
    return total


def _verify(batches, threshold: Fraction):
    """(rep, links, root): documents linked with each class inside its block pair, and the smallest class it reaches there."""
    up, down = threshold.numerator, threshold.denominator
    for table, bounds in whole_runs(batches, ["component", "lo", "hi"]):
        rep, n, m = (table.column(c).to_numpy() for c in ("rep", "n", "grams"))
        lo, hi, own = (table.column(c).to_numpy() for c in ("lo", "hi", "own"))
        m = m.astype(np.int64)
        raw = table.column("set").to_pylist()
        out = ([], [], [])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            both = common([np.frombuffer(r, np.uint64) for r in raw[a:b]])
            size = m[a:b]
            linked = down * both >= up * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            if lo[a] != hi[a]:
                linked &= own[a:b, None] != own[None, a:b]
            count = linked @ n[a:b]
            root = rep[a:b].copy()
            while True:
                lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
                if (lower == root).all():
                    break
                root = lower
            for k in np.flatnonzero(count):
                out[0].append(rep[a + k])
                out[1].append(count[k])
                out[2].append(root[k])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rep", "links", "root"])


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 4, block: int = 2048,
               verify_block: int = 512, block_grams: int = 1 << 20) -> DataFrame:
    """One row per distinct (doc_id, gram set): doc_id, class_id, n_links, component_id, kept.

    class_id is the smallest id among documents of the same gram set; n_links the number of other documents with Jaccard
    similarity of at least ``threshold``, members of the own class included; component_id the smallest id reachable over
    links; kept is doc_id = component_id. Repeated rows count once. Texts without words have no links and are their own
    class. Rows of null id link like others; a class without any id is named by a negative number made from its digest.
    An empty table gives no rows; extra columns are ignored.
    """
    bands = plan_bands(threshold, recall, rows)
    size = bands * rows
    share = Fraction(str(threshold))
    docs = docs.select("doc_id", "text")
    table = checkpoint_frame(signatures(docs, n, size))
    one = table.where("digest IS NOT NULL").groupBy("digest", "doc_id").agg(F.first("grams").alias("grams"), F.first("sig").alias("sig"))
    classes = checkpoint_frame(
        one.groupBy("digest").agg(F.min("doc_id").alias("id0"), F.count(F.lit(1)).alias("n"), F.first("grams").alias("grams"), F.first("sig").alias("sig"))
        .withColumn("rep", F.coalesce("id0", -F.abs(F.shiftright(F.xxhash64("digest"), 1)) - 1))
    )

    def keys(batches):
        spread = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows)
            h = np.zeros((batch.num_rows, bands), np.uint64)
            for r in range(rows):
                h = mix(h * np.uint64(0xD1342543DE82EF95) + sig[:, :, r].astype(np.uint64) + spread)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], ["bucket", "rep"])

    entries = classes.select("rep", "sig").mapInArrow(keys, "bucket long, rep long")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = entries.join(buckets, "bucket").join(classes.select("rep", "grams", "sig"), "rep")
    least = least_agreement(threshold, size)
    found = in_blocks(members.select("bucket", "members", "rep", "grams", "sig"), "bucket", F.ceil(F.col("members") / block), "rep").drop("members")
    near = components(found.mapInArrow(lambda it: _forest(it, least, float(threshold)), "a long, b long"))

    groups = near.withColumnRenamed("node", "rep").join(classes.select("rep", "id0", "digest", "n", "grams"), "rep")
    groups = checkpoint_frame(groups.withColumn("place", F.xxhash64("id0")))
    wanted = Bitmap(groups, "place")

    def load(batches):
        for batch in batches:
            hit = wanted.test(batch.column("place").to_numpy())
            part = batch.filter(pa.array(hit))
            if not part.num_rows:
                continue
            ids, digests, sets = [], [], []
            at = part.column("doc_id").to_pylist()
            for i, _, words in batch_pieces(part.column("text")):
                texts, gram, cut = _sets(words, n)
                for k, t in enumerate(texts):
                    own = gram[cut[k]:cut[k + 1]]
                    ids.append(at[i + t])
                    digests.append(_digest(own))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["id", "dig", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("place", F.xxhash64("doc_id"))
    sets = texts.mapInArrow(load, "id long, dig binary, set binary")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("grams").cast("long")).alias("g"))
    parts = F.ceil(F.greatest(F.col("k") / verify_block, F.col("g") / block_grams))
    full = groups.join(sets, groups["id0"].eqNullSafe(sets["id"]) & (groups["digest"] == sets["dig"])).select("component", "rep", "n", "grams", "digest", "set").dropDuplicates(["digest"])
    pairs = in_blocks(full.drop("digest").join(sizes, "component"), "component", parts, "rep").drop("k", "g")
    links = checkpoint_frame(pairs.mapInArrow(lambda it: _verify(it, share), "rep long, links long, root long"))
    final = components(links.select("rep", "root"))
    named = (
        classes.select("digest", "rep", "n").join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
    )
    return (
        table.select("doc_id", "digest").distinct().join(named, "digest", "left")
        .select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
