"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-grams the smallest hash is kept as a fingerprint, so two texts that share
``window`` consecutive words always share a fingerprint (both keep the smallest of the same k-grams). Fingerprints
of documents are joined with those of the benchmark, and each match is extended: all windows of the document that hold the
matching k-gram are compared with the windows of the benchmark. Items of fewer words than a window are one window and
their own fingerprint, so every document gram of such a length is one as well.

A document's fingerprints first pass a filter of fixed size made from the benchmark's, so only those that (nearly
all) match are shuffled, however large the benchmark is. Windows that occur in the same set of items share one entry of the
item sets, so a passage common to many items and many documents is joined once per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.rolling import Words, batch_pieces, mix, powers
from tallyforge.llm.shared import Bitmap
from tallyforge.session import checkpoint_frame


def smallest(grams: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Indices of grams that are the smallest (the last on ties) of any ``span`` consecutive grams of one text."""
    if not len(grams):
        return np.zeros(0, np.int64)
    if span == 1:
        return np.arange(len(grams))
    m = len(grams) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, where = grams[span - 1:].copy(), np.arange(span - 1, len(grams))
    for j in range(span - 2, -1, -1):
        other = grams[j:m + j]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, np.arange(j, m + j), where)
    whole = at[span - 1:] - at[:m] == span - 1
    whole &= (where >= np.arange(m)) & (where < np.arange(m) + span)
    return np.unique(where[whole])


def _fingerprints(words: Words, window: int, k: int, lengths: list[int]):
    """(fingerprint, text, first word of the gram, its length, 0 for a k-gram) of a piece."""
    doc = words.doc()
    gram, at = words.grams(k)
    # grams of different texts must not meet in a run: places jump between texts
    keep = smallest(gram, at + doc[at] * window if len(at) else at, window - k + 1)
    parts = [(mix(gram[keep]), at[keep], np.zeros(len(keep), np.int32))]
    for n in lengths:
        g, p = words.grams(n)
        parts.append((mix(g + np.uint64(n)), p, np.full(len(g), n, np.int32)))
    value, place, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    return value, doc[place] if len(place) else place, place, size


def benchmark_windows(bench: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, windows) of the items: fp; and item, window, size. Texts equal in words are windowed once each."""
    def add(batches):
        for batch in batches:
            ids = np.array(batch.column("item_id").to_pylist(), object)
            for i, j, words in batch_pieces(batch.column("text")):
                g, p = words.grams(window)
                short, sdoc = words.short_grams(window)
                doc = words.doc()
                text = np.concatenate([doc[p], sdoc]).astype(np.int64) if len(p) else sdoc
                size = np.concatenate([np.full(len(g), window, np.int32), words.count[sdoc].astype(np.int32)])
                value = np.concatenate([g, short])
                fps, fdoc, _, fsize = _fingerprints(words, window, k, [])
                own = words.count[fdoc] >= window if len(fdoc) else np.zeros(0, bool)
                fp = np.concatenate([fps[own], mix(short + words.count[sdoc].astype(np.uint64))])
                n = len(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ids[i:j][text], np.full(len(fp), None, object)]), pa.int64()),
                    pa.array(np.concatenate([value, fp]).view(np.int64)),
                    pa.array(np.concatenate([size, np.zeros(len(fp), np.int32)]))], ["item", "value", "size"])

    rows = checkpoint_frame(bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                            .mapInArrow(add, "item long, value long, size int").distinct())
    return rows.where("size = 0").select(F.col("value").alias("fp")), rows.where("size > 0").select("item", F.col("value").alias("window"), "size")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of an item's window, n_items the items with such a window, items_sha256
    digests their ids (sorted as strings, joined by commas; of no ids, the digest of the empty string); contaminated is
    n_hit > 0 and ``share`` * n_hit >= n_words. Null and empty texts have no words; items without words or id match nothing;
    repeated documents each get their row, repeated items count once per id. Either table may be empty.
    """
    fps, windows = benchmark_windows(bench, window, k)
    lengths = sorted(r[0] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # fewer than ``window`` values
    known = Bitmap(fps, "fp")
    span = window - k

    def scan(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n_words", pa.int64()),
                            ("found", pa.list_(pa.struct([("fp", pa.int64()), ("windows", pa.list_(pa.struct([("start", pa.int32()), ("window", pa.int64()), ("size", pa.int32())])))])))])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, words in batch_pieces(batch.column("text")):
                value, doc, place, size = _fingerprints(words, window, k, lengths)
                hit = known.test(value) if len(value) else np.zeros(0, bool)
                found = [None] * (j - i)
                if hit.any():
                    grams, at = words.grams(window)
                    of = dict(zip(at.tolist(), grams.view(np.int64).tolist(), strict=True)) if hit.sum() > 64 else None
                    for v, d, p, s in zip(value[hit], doc[hit], place[hit], size[hit], strict=True):
                        p, s, base = int(p), int(s), int(words.first[d])
                        if s:
                            around = [{"start": p - base, "window": int(words_hash(words, p, s)), "size": s}]
                        else:
                            low, high = max(p - span, base), min(p, base + int(words.count[d]) - window)
                            if high < low:
                                continue
                            if of is None:
                                a, b = np.searchsorted(at, (low, high + 1))
                                got = zip(at[a:b].tolist(), grams[a:b].view(np.int64).tolist(), strict=True)
                            else:
                                got = ((q, of[q]) for q in range(low, high + 1))
                            around = [{"start": q - base, "window": w, "size": window} for q, w in got]
                        if found[d] is None:
                            found[d] = []
                        found[d].append({"fp": int(v.view(np.int64)), "windows": around})
                total = np.zeros(j - i, np.uint64)
                if len(words.hash):
                    order = mix(words.hash + np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first, words.count).astype(np.uint64))
                    some = words.count > 0
                    total[some] = np.add.reduceat(order, words.first[some])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(total.view(np.int64)), pa.array(words.count.astype(np.int64)), pa.array(found, schema.field("found").type)], schema=schema)

    kind = "doc_id long, sig long, n_words long, found array<struct<fp: long, windows: array<struct<start: int, window: long, size: int>>>>"
    rows = checkpoint_frame(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, kind))
    matched = (
        rows.where("found IS NOT NULL").select("doc_id", "sig", F.explode("found").alias("f")).select("doc_id", "sig", "f.fp", "f.windows")
        .join(fps, "fp", "left_semi").select("doc_id", "sig", F.explode("windows").alias("w")).select("doc_id", "sig", "w.*").distinct()
    )
    sets = checkpoint_frame(
        windows.where("item IS NOT NULL").groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set_id", F.xxhash64("items")))
    hits = checkpoint_frame(matched.join(sets.select("window", "size", "set_id"), ["window", "size"]))
    covered = hits.groupBy("doc_id", "sig").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans")).select(
        "doc_id", "sig", F.expr("""aggregate(spans, named_struct('n', 0L, 'to', 0),
            (a, x) -> named_struct('n', a.n + greatest(0, x.stop - greatest(x.start, a.to)), 'to', greatest(a.to, x.stop)), a -> a.n)""").alias("n_hit"))
    # a set of items is spelled out once per document
    items = sets.groupBy("set_id").agg(F.first("items").alias("items"))
    named = (
        hits.select("doc_id", "sig", "set_id").distinct().join(items, "set_id").select("doc_id", "sig", F.explode("items").alias("item"))
        .groupBy("doc_id", "sig").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    facts = covered.alias("c").join(
        named.alias("i"), F.expr("c.doc_id <=> i.doc_id AND c.sig = i.sig")).select(F.col("c.doc_id").alias("of_id"), F.col("c.sig").alias("of_sig"), "n_hit", "items")
    out = rows.select("doc_id", "sig", "n_words").join(facts, F.expr("doc_id <=> of_id AND sig = of_sig"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def words_hash(words: Words, first: int, n: int) -> np.int64:
    """The hash of the n-gram at a word, as ``Words.grams`` gives it."""
    weight = powers(np.uint64(0xD1342543DE82EF95), n)
    total = (words.hash[first:first + n] * weight).sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(n)], np.uint64)).view(np.int64)[0]
