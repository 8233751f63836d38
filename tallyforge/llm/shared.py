"""Helpers of several operators: runs of equal keys in sorted batches, id filters of fixed size, distinct rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.session import checkpoint_frame

BITS = 24


def fresh_name(name: str, docs: DataFrame) -> str:
    """A column name that begins with two underscores and that ``docs`` does not have in any spelling."""
    name = f"__{name}"
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send texts to Python in batches of ``rows`` rows, unless the session has a setting of its own; bounds workers' memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves no remainder modulo 5; such rows never teach a model."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end between keys, with the bounds of their runs, from batches sorted by integer ``keys``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            kept = table.slice(bounds[-2]).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, _bounds(table, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


class Bitmap:
    """A filter of fixed size (2 ** bits bits, 2 MB by default) over 64-bit values: no false negatives.

    It is built by a distributed OR, so the driver gets at most 2 ** (bits - 6) words however many values there are.
    """

    def __init__(self, values: DataFrame, column: str, bits: int = BITS):
        spark = values.sparkSession
        place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = (
            values.where(F.col(column).isNotNull())
            .groupBy(F.shiftright(place, 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63L as int))")).alias("mask"))
            .toArrow()
        )
        mask = np.zeros(1 << (bits - 6), np.uint64)
        mask[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        self.bits, self.shared = bits, spark.sparkContext.broadcast(mask)

    def test(self, values: np.ndarray) -> np.ndarray:
        """True for every value that was put in, and for few others."""
        v = values.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.shared.value[v >> np.uint64(6)] >> (v & np.uint64(63))) & np.uint64(1) != 0


def without_ids(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one column); rows of null id stay.

    Only rows that a filter of fixed size lets through are shuffled to the exact anti join, so the
    texts of documents that stay are not moved.
    """
    bad = checkpoint_frame(ids.select(F.col(ids.columns[0]).cast("long").alias("bad_id")).where("bad_id IS NOT NULL").distinct()
                           .withColumn("place", F.xxhash64("bad_id")))
    if bad.isEmpty():
        return docs
    bitmap = Bitmap(bad, "place")
    mask = bitmap.shared

    @F.pandas_udf("boolean")
    def maybe(place):
        v = place.to_numpy(np.int64).view(np.uint64) & np.uint64((1 << BITS) - 1)
        import pandas as pd
        return pd.Series((mask.value[v >> np.uint64(6)] >> (v & np.uint64(63))) & np.uint64(1) != 0)

    flag = fresh_name("maybe_out", docs)
    marked = docs.withColumn(flag, F.coalesce(maybe(F.xxhash64(F.col(name).cast("long"))), F.lit(False)))
    stays = marked.where(~F.col(flag)).drop(flag)
    doubt = marked.where(F.col(flag)).drop(flag)
    return stays.unionByName(doubt.join(bad, doubt[name].cast("long") == bad["bad_id"], "left_anti"))


def one_row_each(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with one row of each id that occurs more than once; rows of null id all stay.

    Ids are counted on their column alone; only rows of repeated ids are shuffled.
    """
    repeated = checkpoint_frame(docs.groupBy(F.col(name).alias("many_id")).agg(F.count(F.lit(1)).alias("many")).where("many > 1 AND many_id IS NOT NULL").select("many_id"))
    if repeated.isEmpty():
        return docs
    first = docs.join(repeated, docs[name] == repeated["many_id"], "left_semi").dropDuplicates([name])  # used on keys of equal texts
    return without_ids(docs, repeated, name).unionByName(first)


def row_keys(docs: DataFrame, name: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a key for each distinct (id, text), and the key's column: the id itself where it names one row, else a hash of both.

    Hashes lie above 2 ** 62, so they stand behind ordinary ids. Facts of a row (near copy, contamination) can be told apart by it where several
    rows have one id or none. Ids are counted on their column alone; rows are joined with repeated ids only if there are any.
    """
    key, own = fresh_name("row", docs), F.col(name).cast("long")
    hashed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(own, F.col(text).cast("string")), 2)
    repeated = checkpoint_frame(docs.groupBy(own.alias("many_id")).agg(F.count(F.lit(1)).alias("many")).where("many > 1 AND many_id IS NOT NULL").select("many_id"))
    if repeated.isEmpty():
        return docs.withColumn(key, F.coalesce(own, hashed)), key
    many = fresh_name("many", docs)
    joined = docs.join(repeated.select(F.col("many_id").alias(many)), own == F.col(many), "left")
    return joined.withColumn(key, F.when(own.isNull() | F.col(many).isNotNull(), hashed).otherwise(own)).drop(many), key


def in_blocks(members: DataFrame, key: str, parts: Column, by: str) -> DataFrame:
    """Members once for each pair of blocks that their block is in; lo and hi name the pair, own the member's block."""
    own = F.pmod(F.xxhash64(by), parts).cast("int")
    return (
        members.withColumn("parts", parts.cast("int")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "parts")
        .repartition(F.col(key), F.col("lo"), F.col("hi")).sortWithinPartitions(key, "lo", "hi", by)
    )


def root_of(parent: list[int], x: int) -> int:
    """The root of a node, with the path to it shortened."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x
