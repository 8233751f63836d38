"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.session import checkpoint_frame


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (first two columns, integers); component is the smallest id reachable.

    Loops, repeated links and links in either direction are allowed; nulls are skipped. Each round replaces a
    node's links by links to the smallest neighbour, first for its larger and then for its smaller neighbours;
    the minimum per node is combined before the shuffle, and the join back on a hub can be split by Spark. The table of a
    round is written to the shared checkpoint folder. An empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    )
    e = checkpoint_frame(e)
    before = _sign(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = checkpoint_frame(small.where("u <> v").distinct())
        after = _sign(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sign(e: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
