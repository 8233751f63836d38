"""Bookkeeping over users, uploads and tickets: joins, latest rows, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col


def attach_left(left: DataFrame, right: DataFrame, keys: list[str], required: str) -> DataFrame:
    """Left join that then drops rows without the required attached column."""
    return left.join(right, keys, "left").where(col(required).isNotNull())


def tickets_with_users(tickets: DataFrame, users: DataFrame) -> DataFrame:
    """Tickets with the address of their user, newest first."""
    return tickets.join(users.select("user_id", "email"), "user_id").orderBy(F.desc("created_at"), F.desc("ticket_id"))


def users_with_upload_counts(users: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every user with the number of uploads; counted before the join, so a busy user is one row."""
    counts = uploads.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_uploads"))
    return users.join(counts, "user_id", "left").withColumn("total_uploads", F.coalesce("total_uploads", F.lit(0)))


def latest_upload(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Per user the upload the user points to, else the newest one.

    ``max_by`` combines map-side, so no user's uploads are sorted or gathered.
    """
    pointers = users.select("user_id", "latest_upload_id")
    joined = uploads.join(pointers, "user_id")
    rank = F.struct(
        F.coalesce(F.col("upload_id") == F.col("latest_upload_id"), F.lit(False)), F.col("created_at"), F.col("upload_id")
    )
    rest = [c for c in uploads.columns if c != "user_id"]
    return joined.groupBy("user_id").agg(F.max_by(F.struct(*rest), rank).alias("u")).select("user_id", "u.*")


def recent_uploads(uploads: DataFrame, n: int = 10) -> DataFrame:
    """The last n uploads per user; ``row_number <= n`` is applied before the shuffle."""
    order = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("upload_id"))
    return uploads.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search_history(
    uploads: DataFrame, text: str, pinned: Column | None = None, oldest_first: bool = False, limit: int | None = None
) -> DataFrame:
    """Uploads whose name or summary holds the text, pinned ones first."""
    needle = F.lit(text.lower())
    found = uploads.where(F.contains(F.lower("filename"), needle) | F.contains(F.lower("summary"), needle))
    pinned = F.lit(False) if pinned is None else pinned
    when = [F.asc("created_at"), F.asc("upload_id")] if oldest_first else [F.desc("created_at"), F.desc("upload_id")]
    ordered = found.withColumn("pinned", pinned).orderBy(F.desc("pinned"), *when)
    return ordered if limit is None else ordered.limit(limit)


def delete_uploads(uploads: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining uploads, files no remaining upload refers to)."""
    remaining = uploads.join(doomed.select("upload_id"), "upload_id", "left_anti")
    gone = uploads.join(doomed.select("upload_id"), "upload_id", "left_semi").select("filename").distinct()
    return remaining, gone.join(remaining.select("filename"), "filename", "left_anti")


def aligned_delta(before: DataFrame, after: DataFrame, key: str, measure: str) -> DataFrame:
    """after - before per key; a missing side is 0."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum(col(measure)).alias(name))

    joined = total(before, "before").join(total(after, "after"), key, "full_outer")
    b, a = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return joined.select(key, b.alias("before"), a.alias("after"), (a - b).alias("delta"))


def flagged_union(frames: list[DataFrame]) -> DataFrame:
    """Set union of flagged row keys."""
    return reduce(DataFrame.unionByName, frames).dropDuplicates()


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Sort and keep k rows: a bounded heap per task, no global sort."""
    return df.orderBy(*order).limit(k)
