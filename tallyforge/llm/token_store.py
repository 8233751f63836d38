"""Token id files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder of three Parquet tables, so that any file system Spark writes to will do and a lost task is simply run again:

- ``dictionary``: hash (SHA-256) and bytes of the dictionary, the id width in bytes, the tokenizer's hash;
- ``blocks``: part, block, first_doc, last_doc, dictionary hash, ``payload`` (frames one after the other, about
  ``BLOCK`` bytes) and the index of the block: doc_ids, n_tokens, starts (ids of the part before a document), offsets;
- ``parts``: part, n_tokens and the ids before the part.

Parts are ranges of doc_id in ascending order (null first), blocks and documents follow in order inside them. A frame
holds the ids of one document as little-endian unsigned integers, so one document is read by decoding its frame alone.

Ids are made on the map side and only compressed frames are shuffled. Range bounds come from a sketch of doc_id, whose
accuracy moves only the sizes of parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.encoder import encoder_of, slices
from tallyforge.llm.rolling import release

BLOCK = 1 << 20
PART = 1 << 29


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = 1000, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from the id arrays of at most ``sample`` documents, those of the smallest hash of the id.

    Only ids, not texts, reach the driver: at most 1 000 ids of a document. Where there is too little to train on, the
    dictionary is empty and frames are compressed without one.
    """
    picked = docs.select(F.xxhash64("doc_id").alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lowest = picked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if lowest is None:
        return b""

    def ids(batches):
        own = encoder_of(tokenizer)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, bounds = own.encode(batch.column("text"))
            got = [ids[a:min(b, a + 1000)].astype(f"<u{own.width}").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(got, pa.binary())], ["h", "ids"])

    rows = picked.where(F.col("h") <= lowest).mapInArrow(ids, "h long, ids binary").orderBy("h", "ids").limit(sample).collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(raw: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    own = zstandard.ZstdCompressionDict(raw) if raw else None
    return zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=False, write_content_size=True), zstandard.ZstdDecompressor(dict_data=own)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write a store under ``path``.

    Repeated ids keep all their rows, in order of their frames; extra columns are ignored; an empty table gives a store without
    blocks. ``tokenizer`` is a file that every executor can read, or finds at the same place.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)
    cuts, parts = _cuts(docs, parts)

    def encode(batches):
        own, (pack, _) = encoder_of(tokenizer), _compressor(shared.value)
        for batch in (part for whole in batches for part in slices(whole)):
            doc_ids = batch.column("doc_id")
            place = np.searchsorted(cuts, doc_ids.fill_null(-2**63).to_numpy(), side="left").astype(np.int32)
            ids, bounds = own.encode(batch.column("text"))
            end, kind, frames = np.array([end_id], f"<u{own.width}"), f"<u{own.width}", []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                frames.append(pack.compress(np.concatenate([ids[a:b].astype(kind), end]).data))
            yield pa.RecordBatch.from_arrays([pa.array(place), doc_ids, pa.array((np.diff(bounds) + 1).astype(np.int32)),
                                              pa.array(frames, pa.binary())], ["part", "doc_id", "n_tokens", "frame"])

    frames = docs.mapInArrow(encode, "part int, doc_id long, n_tokens int, frame binary")
    frames = frames.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    blocks = frames.mapInArrow(lambda it: _pack(it, name), _BLOCKS)
    blocks.write.parquet(f"{path}/blocks")
    width = encoder_of(tokenizer).width
    with open(tokenizer, "rb") as f:
        made = hashlib.file_digest(f, "sha256").hexdigest()
    spark.createDataFrame([(name, bytearray(raw), width, made)], "hash string, bytes binary, width int, tokenizer string").coalesce(1).write.parquet(f"{path}/dictionary")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("n_tokens"))
    from pyspark.sql.window import Window as W
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per part
    totals.withColumn("before", before.cast("long")).write.parquet(f"{path}/parts")


def _cuts(docs: DataFrame, parts: int | None) -> tuple[np.ndarray, int]:
    """Upper bounds of all parts but the last, and the number of parts: at least the session's, and one per ``PART`` bytes of text."""
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    at = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else None
    cuts = np.unique(np.array(at or [], np.int64))
    return cuts, len(cuts) + 1


_BLOCKS = ("part int, block int, first_doc long, last_doc long, dictionary string, tokens long, payload binary, "
           "doc_ids array<long>, n_tokens array<int>, starts array<long>, offsets array<long>")


def _pack(batches: Iterator[pa.RecordBatch], name: str):
    """Blocks of sorted frames; a block ends at ``BLOCK`` bytes or with its part, so memory holds one block."""
    part, block, start, held, size = None, 0, 0, [], 0

    def flush():
        nonlocal block, start, held, size
        ids, counts, frames = [h[0] for h in held], np.array([h[1] for h in held], np.int64), [h[2] for h in held]
        starts = start + np.append(0, np.cumsum(counts)[:-1])
        offsets = np.append(0, np.cumsum([len(f) for f in frames]))
        known = [i for i in ids if i is not None]
        row = pa.RecordBatch.from_pylist([{
            "part": part, "block": block, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "dictionary": name,
            "tokens": int(counts.sum()), "payload": b"".join(frames), "doc_ids": ids, "n_tokens": counts.tolist(), "starts": starts.tolist(), "offsets": offsets.tolist()}],
            schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dictionary", pa.string()), ("tokens", pa.int64()),
                              ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))]))
        block, start, held, size = block + 1, start + int(counts.sum()), [], 0
        return row

    for batch in batches:
        for p, i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame")), strict=True):
            if held and (p != part or size >= BLOCK):
                yield flush()
            if p != part:
                part, block, start = p, 0, 0
            held.append((i, n, frame))
            size += len(frame)
    if held:
        yield flush()


def _dictionaries(spark: SparkSession, path: str) -> tuple[bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["bytes"])
    if hashlib.sha256(raw).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return raw, row["width"]


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, or of ``doc_ids`` alone.

    With ``doc_ids`` only blocks whose range of ids holds one of them are read, and only their frames are decoded.
    """
    raw, width = _dictionaries(spark, path)
    name, shared = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "dictionary", "payload", "doc_ids", "n_tokens", "starts", "offsets", "first_doc", "last_doc")
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        inside = F.lit(False)
        for i in wanted:
            inside = inside | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
        blocks = blocks.where(inside)

    def decode(batches):
        unpack = _compressor(shared.value)[1]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("part", "dictionary", "payload", "doc_ids", "n_tokens", "starts", "offsets")}
                if row["dictionary"] != name:
                    raise ValueError("a block was made with another dictionary")
                at = [k for k, i in enumerate(row["doc_ids"]) if wanted is None or i in wanted]
                for a in range(0, len(at), 500):
                    some = at[a:a + 500]
                    ids = [unpack.decompress(row["payload"][row["offsets"][k]:row["offsets"][k + 1]]) for k in some]
                    ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in ids]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["part"]] * len(some), pa.int32()), pa.array([row["doc_ids"][k] for k in some], pa.int64()),
                        pa.array([row["starts"][k] for k in some], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["part", "doc_id", "start", "n_tokens", "ids"])
            release()

    rows = blocks.drop("first_doc", "last_doc").mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids binary")
    before = spark.read.parquet(f"{path}/parts").select("part", "before")  # one row per part: bounded by the number of parts
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["digest", "read_store", "train_dictionary", "write_store"]
