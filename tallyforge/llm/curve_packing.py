"""Packing of documents into sequences along a space-filling curve.

A document's token counts are hashed into ``BUCKETS`` cells and projected to ``DIMS`` dimensions by a random integer matrix; the
mean over its tokens is a point of a fixed cube, whose place on a Hilbert curve (Skilling's transform of the coordinates,
2004) is the document's key. Rows are dealt out by ranges of (key, doc_id) and sorted by it, so similar documents lie side by side
and equal documents can be spread over tasks. Every range fills its sequences to the last token, cutting documents where a
sequence ends; what is left at its end goes to sequences whose lengths are the powers of two that add up to it. So no sequence
is padded, and a range is packed in one pass that holds one batch and less than a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.encoder import encoder_of, slices
from tallyforge.session import staged_table

LENGTH = 4096
BUCKETS, DIMS, BITS, REACH = 4096, 3, 20, 1000
RANGE = 1 << 27
_KIND = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def projection(size: int) -> np.ndarray:
    """The ``DIMS`` coordinates that one token of each id below ``size`` adds to a document's projection."""
    cell = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.random.default_rng(20250311).integers(-REACH, REACH + 1, (BUCKETS, DIMS))[cell.astype(np.int64)]


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points given as rows of whole coordinates below 2 ** bits."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for i in range(n):
            upper = (x[:, i] & half) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(upper, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, curve key and ids (with ``end_id``; little-endian, of the encoder's width) of every row."""
    def encode(batches):
        own = encoder_of(tokenizer)
        table, kind = projection(max(own.size, end_id + 1)), f"<u{own.width}"
        for batch in (part for whole in batches for part in slices(whole)):
            ids, bounds = own.encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            total = np.stack([np.add.reduceat(table[ids, k], bounds[:-1]) for k in range(DIMS)], axis=1)
            point = (total / np.diff(bounds)[:, None] + REACH) / (2 * REACH)
            key = hilbert_key(np.minimum((point * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key), _runs(ids.astype(kind), bounds)], ["doc_id", "place", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, place long, ids binary")


def _runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The runs of ``values`` between ``bounds`` as binary values, without a copy."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def tail_lengths(left: int) -> list[int]:
    """The powers of two that add up to ``left``, largest first."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def fill(batches: Iterator[pa.RecordBatch], width: int, length: int, first: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of a range, in order; sequences are numbered from ``first``."""
    doc_id, start, total = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def cut(lengths: np.ndarray):
        """Emit sequences of these lengths from what is held; the rest stays held."""
        nonlocal doc_id, start, total, ids, bounds, first
        ends = np.append(0, np.cumsum(lengths))
        last = int(ends[-1])
        edges = np.union1d(bounds[bounds <= last], ends)
        at, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(bounds, at, side="right") - 1
        seq = np.searchsorted(ends, at, side="right") - 1
        out = pa.RecordBatch.from_arrays([
            doc_id.take(pa.array(doc)), pa.array(start[doc] + at - bounds[doc]), pa.array(stop - at), _runs(ids[:last].astype("<u4"), edges),
            pa.array(total[doc]), pa.array(first + seq), pa.array(at - ends[seq])], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        first += len(lengths)
        keep = int(np.searchsorted(bounds, last, side="right")) - 1  # the document that is cut there, or the next one
        start = np.append(start[keep:keep + 1] + last - bounds[keep], start[keep + 1:])
        doc_id, total, ids, bounds = doc_id.slice(keep), total[keep:], ids[last:], np.append(0, bounds[keep + 1:] - last)
        return out

    for batch in batches:
        column = batch.column("ids")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        if not len(column):
            continue
        new = np.frombuffer(column.buffers()[2], f"<u{width}", (offsets[-1] - offsets[0]) // width, int(offsets[0]))
        sizes = np.diff(offsets) // width
        bounds = np.append(bounds, len(ids) + np.cumsum(sizes))
        ids = np.concatenate([ids, new.astype(np.uint32)])
        doc_id = pa.concat_arrays([doc_id, batch.column("doc_id")])
        start, total = np.append(start, np.zeros(len(sizes), np.int64)), np.append(total, sizes)
        if len(ids) >= length:
            yield cut(np.full(len(ids) // length, length))
    if len(ids):
        yield cut(np.array(tail_lengths(len(ids))))


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every token of every row (ids of the whole text and ``end_id``; null and empty texts have ``end_id`` alone) lies in one piece, and
    sequences have ``length`` tokens or a power of two below it. Repeated rows and null ids are packed as they are, extra columns are
    ignored, an empty table gives no pieces. ``length`` is a power of two. Encoded rows are written once to the shared folder;
    the number of ranges is the session's, or one per ``RANGE`` bytes of ids.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    rows, width = staged_table(encoded(docs, tokenizer, end_id)), encoder_of(tokenizer).width
    size = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))

    def run(batches):
        return fill(batches, width, length, TaskContext.get().partitionId() << 40)

    return rows.repartitionByRange(ranges, "place", "doc_id").sortWithinPartitions("place", "doc_id", "ids").drop("place").mapInArrow(run, _KIND)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, padded with ``pad_id`` to ``length`` unless its length is a power of two.

    A sequence has at most ``length`` pieces, so what meets in a group is bounded.
    """
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    power = F.expr("bit_count(n_tokens) = 1")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.when(power, ids).otherwise(F.concat(ids, pad)).alias("ids"))
