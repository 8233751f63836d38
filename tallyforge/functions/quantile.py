"""Exact interpolated quantiles without a per-group value map.

The built-in ``percentile`` keeps every distinct value of a group in one task.
Here a sketch first gives a narrow bracket round each wanted rank; a second pass
keeps distinct values only inside the brackets and plain counts outside them, so
one group never moves more than a few thousandths of its rows and equal values
are combined before the shuffle. Where a group still holds more than ``ROWS``
distinct values, rounds follow: its values are cut into ranges, the ranges are counted,
and only ranges with a wanted rank keep their values; each of the others becomes
one row. So no task ever sorts more than about ``ROWS`` rows of a group. Ranks are then
read off exact cumulative counts. A sketch that missed its bracket raises instead of
returning a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import any_of, col, total_of
from tallyforge.session import checkpoint_frame

_ACCURACY = 10000
ROWS = 100_000
_RANGES = 64


def unpivot_numeric(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., column, value DOUBLE), nulls left out."""
    narrow = df.select(*[col(b) for b in by], *[col(c).cast("double").alias(c) for c in columns])
    return narrow.unpivot([col(b) for b in by], [col(c) for c in columns], "column", "value").where("value IS NOT NULL")


def _running(keys: list[str]):
    return W.partitionBy(*keys).orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)


def _narrowed(counted: DataFrame, keys: list[str], probs: list[float], rows: int) -> DataFrame:
    """``counted`` (keys, n, rows, lo, hi; disjoint value ranges) with at most about ``rows`` rows of each key, exact at every wanted rank.

    A round cuts the rows of a large key at 63 of their own quantiles, so it leaves at most some rows in 64 for each rank,
    whatever the values are. Only sums by range are gathered: at most 64 rows of a key.
    """
    counted = checkpoint_frame(counted)
    while (most := counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("own")).agg(F.max("own")).first()[0]) is not None and most > rows:
        sizes = counted.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("own"), F.percentile_approx("lo", [k / _RANGES for k in range(1, _RANGES)], 1000).alias("cuts"))
        large = sizes.where(F.col("own") > rows).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "cuts")
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
        ranged = counted.join(large, same, "left").drop(*[f"_{i}" for i in range(len(keys))])
        ranged = checkpoint_frame(ranged.withColumn("range", F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("lo"))))).drop("cuts"))
        sums = ranged.where("range IS NOT NULL").groupBy(*keys, "n", "range").agg(
            F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("values"))
        upto = sums.withColumn("upto", F.sum("rows").over(_running(keys)))
        ranks = [f(F.lit(float(p)) * (F.col("n") - 1)) for p in probs for f in (F.floor, F.ceil)]
        upto = checkpoint_frame(upto.withColumn("wanted", any_of([(F.col("upto") - F.col("rows") <= r) & (r < F.col("upto")) for r in ranks])))
        open_ranges = upto.where("wanted").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("range").alias("_range"))
        kept = ranged.where("range IS NOT NULL").join(open_ranges, [*same, F.col("range") == F.col("_range")], "left_semi")
        shut = upto.where("NOT wanted")
        after = [f.select(*keys, "n", "rows", "lo", "hi") for f in (ranged.where("range IS NULL"), kept, shut)]
        narrower = checkpoint_frame(after[0].unionByName(after[1]).unionByName(after[2]))
        if narrower.count() >= counted.count():  # a key of 64 ranges cannot be cut further
            return narrower
        counted = narrower
    return counted


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (), rows: int = ROWS) -> DataFrame:
    """One row per (by..., column): ``n`` and ``q`` = array of quantiles in the order of ``probs``.

    Linear interpolation between the two neighbouring ranks, as in pandas. The table is read twice, at once; ``rows`` bounds
    what one task sorts of a group.
    """
    by = list(by)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    wanted = [probs[i] for i in order]
    long = unpivot_numeric(df, columns, by)
    keys = by + ["column"]

    brackets: list[float] = []
    for p in wanted:
        brackets += [max(0.0, p - 2 / _ACCURACY), min(1.0, p + 2 / _ACCURACY)]
    def sketched(value: Column) -> list[Column]:
        return [F.count(value).alias("n"), F.percentile_approx(value, [float(b) for b in brackets], _ACCURACY).alias("bounds")]

    if by:
        sketch = long.groupBy(*keys).agg(*sketched(F.col("value")))
    else:
        sketch = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), *sketched(col(c).cast("double"))) for c in columns]).alias("s")).select(F.inline("s")).where("n > 0")
    # Without group keys the sketch has one row per column, so its size is known.
    placed = long.join(sketch if by else F.broadcast(sketch), keys)

    low = [F.col("bounds")[2 * i] for i in range(len(wanted))]
    high = [F.col("bounds")[2 * i + 1] for i in range(len(wanted))]
    value = F.col("value")
    gap = total_of([(value > h).cast("int") for h in high])
    inside = any_of([value.between(a, b) for a, b in zip(low, high)])
    counted = (
        placed.select(*keys, "n", "value", gap.alias("gap"), F.when(inside, value).alias("kept"))
        .groupBy(*keys, "n", "gap", "kept")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    counted = _narrowed(counted.drop("gap", "kept"), keys, wanted, rows)
    ranked = counted.withColumn("upto", F.sum("rows").over(_running(keys)))

    def at(rank: Column) -> Column:
        here = (F.col("upto") - F.col("rows") <= rank) & (rank < F.col("upto"))
        # The ends of a counted range are known exactly, which covers the ranks next to a bracket.
        safe = (
            F.when((F.col("lo") == F.col("hi")) | (rank == F.col("upto") - F.col("rows")), F.col("lo"))
            .when(rank == F.col("upto") - 1, F.col("hi"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        )
        return F.max(F.when(here, safe))

    aggs = []
    for i, p in enumerate(wanted):
        position = F.lit(float(p)) * (F.col("n") - 1)
        aggs += [at(F.floor(position)).alias(f"x{i}"), at(F.ceil(position)).alias(f"y{i}")]
    found = ranked.groupBy(*keys, "n").agg(*aggs)
    quantiles: list[Column] = [F.lit(None)] * len(probs)
    for i, p in enumerate(wanted):
        position = F.lit(float(p)) * (F.col("n") - 1)
        quantiles[order[i]] = F.col(f"x{i}") + (F.col(f"y{i}") - F.col(f"x{i}")) * (position - F.floor(position))
    return found.select(*keys, "n", F.array(*quantiles).alias("q"))


def exact_median_time(df: DataFrame, time: str) -> DataFrame:
    """One row ``mid`` (microseconds, DOUBLE): the median of a timestamp column."""
    micros = df.select(F.unix_micros(col(time).cast("timestamp")).alias("t"))
    return exact_quantiles(micros, ["t"], [0.5]).select(F.col("q")[0].alias("mid"), "n")
