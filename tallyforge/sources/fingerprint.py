"""Content hashes of tables and files, and the look-up of an earlier result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyforge.functions.lookups import REPORT_VERSION
from tallyforge.functions.semantics import col


def row_text(df: DataFrame, columns: list[str] | None = None):
    """One row as text; every value is length-prefixed so that different rows never look alike."""
    parts = []
    for c in columns or df.columns:
        text = col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """Rows and an order-independent content hash; sums are combined map-side.

    ``method='sha2'`` adds the first 15 hex digits of each row's SHA-256 instead,
    a form every SQL engine can repeat.
    """
    if method == "sha2":
        digest = F.conv(F.substring(F.sha2(row_text(df, columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    else:
        digest = F.xxhash64(*[col(c) for c in columns or df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).cast("string").alias("content_hash"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("dataset_hash"))


def cached_results(
    uploads: DataFrame, history: DataFrame, version: str = REPORT_VERSION, by: tuple[str, ...] = ("user_id",)
) -> DataFrame:
    """Newest earlier result of the same content and version for each upload."""
    keys = [*by, "dataset_hash"]
    latest = W.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("result_id"))
    newest = (
        history.where(F.col("version") == version)
        .withColumn("_rank", F.row_number().over(latest))
        .where("_rank = 1")
        .select(*keys, "result_id")
    )
    return uploads.join(newest, keys)
