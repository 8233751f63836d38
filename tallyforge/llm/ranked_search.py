"""Ranked lexical search, term at a time with a limit on accumulators.

Documents are read once: their counts of the terms that items ask for are written as a narrow table, together with their number
of terms. The corpus counts (documents, terms, documents of each term) are summed over all documents. Every task then ranks
its own documents, shard after shard: the terms of an item are taken rarest first, each adds its part to the accumulators
of the documents that hold it, and once the largest parts that the remaining terms can have in the shard do not reach the kth
best score known so far, no further accumulators are made; those that exist are updated exactly with all remaining terms. The
kth score comes from the scores that the task has finished and from the shard's partial scores, both of which only grow, so no
document of the final ranking is lost. Tasks pass on their best k of each item, and these are merged by rank.

Items are sent to the tasks in blocks of bounded size; each block reads the documents again. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.rolling import batch_pieces
from tallyforge.session import checkpoint_frame, staged_table

BEST = 10
BLOCK = 200_000
SHARD = 1 << 20
_POSTINGS = "doc_id long, n long, terms binary, counts binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item, term (hash) and times: how often each item's text holds each of its terms. ``item`` numbers distinct (item_id, text)."""
    def add(batches):
        for batch in batches:
            keys = batch.column("item").to_numpy()
            for i, j, words in batch_pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][words.doc()]), pa.array(words.hash.view(np.int64))], ["item", "term"])

    return items.mapInArrow(add, "item long, term long").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats) and, of the sorted term hashes ``asked``, the numbers and counts of those that a document holds."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def scan(batches):
        own = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, words in batch_pieces(batch.column("text")):
                at = np.searchsorted(own, words.hash.view(np.int64))
                at[at == len(own)] = 0
                held = own[at] == words.hash.view(np.int64) if len(own) else np.zeros(len(at), bool)
                pairs, counts = np.unique(words.doc()[held] * max(len(own), 1) + at[held], return_counts=True)
                doc, term = np.divmod(pairs, max(len(own), 1))
                bounds = (np.searchsorted(doc, np.arange(j - i + 1)) * 4).astype(np.int32)
                terms, times = (pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(x.astype("<u4"))]) for x in (term, counts))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(words.count.astype(np.int64)), terms, times], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, _POSTINGS)


def _numbers(column: pa.Array) -> np.ndarray:
    """All 32-bit numbers of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, "<u4", (int(offsets[-1]) - int(offsets[0])) // 4, int(offsets[0])).astype(np.int64) if data is not None else np.zeros(0, np.int64)


def corpus_counts(rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with at least one term, terms of all documents, and documents that hold each asked term. Tasks sum before the shuffle."""
    def count(batches):
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(_numbers(batch.column("terms")), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    found = rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most one row per asked term
    df = np.zeros(terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return total["docs"], total["words"], df


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term, in doubles."""
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """The documents of a shard, their postings by term, and the parts of scores that postings give."""

    def __init__(self, batches: list[pa.RecordBatch], docs: int, words: int, weight: np.ndarray):
        table = pa.Table.from_batches(batches)
        self.known = table.column("doc_id").is_valid().to_numpy()
        self.ids = table.column("doc_id").fill_null(0).to_numpy()
        n = table.column("n").to_numpy()
        term = np.concatenate([_numbers(b.column("terms")) for b in batches])
        tf = np.concatenate([_numbers(b.column("counts")) for b in batches])
        sizes = np.concatenate([np.diff(np.frombuffer(b.column("terms").buffers()[1], np.int32)[b.column("terms").offset:b.column("terms").offset + len(b) + 1]) for b in batches]) // 4
        doc = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        m = 25 + 75 * n * docs // max(words, 1)
        self.part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc]))
        self.bounds = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.bounds))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.part, self.bounds[some])

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, exact score) of all documents of the shard that may be among the best k; ``known``: a score that k documents reach.

        ``terms`` are in the order in which they are taken, rarest first.
        """
        score = np.zeros(len(self.ids), np.int64)
        left = self.most[terms] * times
        left = np.append(np.cumsum(left[::-1])[::-1], 0)
        alive: np.ndarray | None = None
        for x, (term, often) in enumerate(zip(terms.tolist(), times.tolist(), strict=True)):
            if alive is None:
                bar = known
                if left[x] < score.max(initial=0) and len(score) >= k:
                    bar = max(bar, int(np.partition(score, -k)[-k]))
                if left[x] < bar:  # a document without an accumulator can no longer get in
                    alive = score > 0
            a, b = self.bounds[term], self.bounds[term + 1]
            doc, part = self.doc[a:b], self.part[a:b]
            if alive is not None:
                held = alive[doc]
                doc, part = doc[held], part[held]
            score[doc] += part * often  # a document stands once in a posting list
        found = np.flatnonzero((score > 0) & (score >= known))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return found, score[found]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they hold about ``SHARD`` postings."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("terms").nbytes // 4
        if size >= SHARD:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rank_block(rows: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], docs: int, words: int, weight: np.ndarray, k: int) -> DataFrame:
    """item, doc_id and score of the best k documents of each task. ``asked``: item, numbers of its terms rarest first, their repeats."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, weight))

    def rank(batches):
        own, w = shared.value
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in own]
        for held in _shards(batches):
            shard = Shard(held, docs, words, w)
            for x, (_, terms, times) in enumerate(own):
                scores, ids, known = top[x]
                doc, score = shard.best(terms, times, k, int(scores[k - 1]) if len(scores) >= k else 0)
                if len(doc):
                    scores, ids, known = np.append(scores, score), np.append(ids, shard.ids[doc]), np.append(known, shard.known[doc])
                    order = np.lexsort((ids, ~known, -scores))[:k]
                    top[x] = scores[order], ids[order], known[order]
        for (item, _, _), (scores, ids, known) in zip(own, top, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), pa.array(ids, pa.int64(), mask=~known), pa.array(scores)], ["item", "doc_id", "score"])

    return rows.mapInArrow(rank, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``k`` best documents with a score above 0, equal scores by ascending doc_id (null last).

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII in the whole text, A-Z lower-cased; null and empty texts have
    none. A score is exact: whole-number parts by term, repeats of a term in the item counted. Rows of ``items`` equal in item_id and
    text are one item, rows of one item_id with other texts are ranked each. Repeated documents are ranked each; other columns
    are ignored; an empty table on either side gives no rows. ``block`` bounds the (item, term) pairs that are sent to all tasks at once.
    """
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    # numbered by a total order of the rows, so that a recomputed task gives the same numbers
    own = own.withColumn("item", F.xxhash64("item_id", "text"))
    pairs = checkpoint_frame(item_terms(own.select("item", "text")))
    names = checkpoint_frame(own.select("item", "item_id"))
    size = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("terms"))
    total, most = size.agg(F.sum("terms"), F.max("terms")).first()
    parts = -(-(total or 0) // block)
    placed = pairs.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(max(parts, 1))))
    best: DataFrame | None = None
    for part in range(parts):
        # about ``block`` rows: blocks are dealt by a hash of the item, and one item is never split
        table = placed.where(F.col("block") == part).select("item", "term", "times").toArrow()
        if not table.num_rows:
            continue
        term = np.unique(table.column("term").to_numpy())
        rows = staged_table(postings(docs, term))
        n_docs, words, df = corpus_counts(rows, len(term))
        number, times, item = np.searchsorted(term, table.column("term").to_numpy()), table.column("times").to_numpy(), table.column("item").to_numpy()
        held = df[number] > 0
        number, times, item = number[held], times[held], item[held]
        order = np.lexsort((number, df[number], item))
        number, times, item = number[order], times[order], item[order]
        cuts = np.append(np.flatnonzero(np.diff(item, prepend=item[0] - 1)) if len(item) else [], len(item)).astype(np.int64)
        asked = [(int(item[a]), number[a:b], times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        got = _rank_block(rows, asked, n_docs, words, weights(n_docs, df), k)
        best = got if best is None else best.unionByName(got)
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)  # at most k rows of a task and item are ranked
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
