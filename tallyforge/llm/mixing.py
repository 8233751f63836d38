"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words (``targets``). A document of a source with target t and size s is due t / s copies: the whole
part is certain, the rest is its inclusion probability p. Documents are ranked by their random odds u / (1 - u) over
their inclusion odds p / (1 - p), and the lowest ranks are taken until the source's remaining words are met (to the
nearest document). Large documents (above the source's mean size) are ranked first, and what they miss or exceed is
left to the small ones, so the words taken come near the target.

u is a hash of id, source and text, so reruns agree; rows equal in all three share one draw. The cut in the ranking is found
without sorting a source: words are summed per range of the ranking (2 ** 10 ranges), the range with the cut is divided
again, and only the rows of the last range are ordered. All tables that meet in one task are bounded by the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.shared import fresh_name
from tallyforge.session import checkpoint_frame

WIDTH = 10
BITS = 53


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, source: Column, text: Column) -> Column:
    """A uniform whole number below 2 ** 53 that stands for u."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), doc_id, source, text), 64 - BITS)


def rank(u: Column, p: Column) -> Column:
    """Pareto rank q = odds(u) / odds(p) as a whole number: q / (1 + q) in steps of 2 ** -53, so it rises with q."""
    x = (u + F.lit(0.5)) / F.lit(float(1 << BITS))
    q = x / (1 - x) * (1 - p) / p
    return F.floor(q / (1 + q) * F.lit(float(1 << BITS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row per source.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words by them; a target stops at ``most``
    times the source's size and the excess is shared by weight among the rest. The level at which nothing is above its stop is
    read off the sources sorted by stop per weight.
    """
    place = W.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size")).withColumn("weight", turn)
    t = t.withColumn("stop", F.col("source_size") * float(most)).withColumn("ratio", F.col("stop") / F.col("weight"))
    everything = W.partitionBy()
    upto = W.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share)).withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the level that holds is the one of the first source (by ratio) that stays below its stop
    t = t.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("settled").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("settled") * F.col("weight"))).alias("target"))


def _cut(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(key, cut, taken): ranks below ``cut`` are taken and hold ``taken`` words, as near to ``goal`` (key, want) as whole documents allow.

    ``rows``: key, place (the rank), size. ``key`` is never null.
    """
    state = goal.select("key", F.col("want").cast("double").alias("want"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("got"))
    left = rows
    for level in (1, 2):
        shift = BITS - WIDTH * level
        part = left.join(state.select("key", "prefix"), "key").where(F.shiftrightunsigned("place", shift + WIDTH) == F.col("prefix")) if level > 1 else left
        sums = part.groupBy("key", F.shiftrightunsigned("place", shift).alias("range")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        run = run.join(state.select("key", "want", "got"), "key")
        # the last range that begins before the goal is met, or the first range
        at = run.where((F.col("before") + F.col("got") < F.col("want")) | (F.col("before") == 0)).groupBy("key").agg(
            F.max(F.struct("range", "before")).alias("x"), F.first("want").alias("want"), F.first("got").alias("got"))
        state = checkpoint_frame(at.select("key", "want", F.col("x.range").alias("prefix"), (F.col("got") + F.col("x.before")).alias("got")))
    last = left.join(state, "key").where(F.shiftrightunsigned("place", BITS - 2 * WIDTH) == F.col("prefix"))
    # rows of equal draw are one step, so ties never split
    steps = last.groupBy("key", "place", "want", "got").agg(F.sum("size").alias("words"))
    run = steps.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("place")) + F.col("got"))
    near = run.withColumn("miss", F.abs(F.col("upto") - F.col("want")))
    best = near.groupBy("key").agg(F.min(F.struct("miss", "place", "upto")).alias("b"), F.first("want").alias("want"), F.first("got").alias("got"))
    none = (F.col("want") - F.col("got")) <= F.col("b.miss")
    floor = F.shiftleft(F.element_at(F.array("p"), 1), BITS - 2 * WIDTH)
    best = best.join(state.select("key", F.col("prefix").alias("p")), "key")
    return best.select("key", F.when(none, floor).otherwise(F.col("b.place") + 1).alias("cut"), F.when(none, F.col("got")).otherwise(F.col("b.upto")).alias("taken"))


def plan(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, certain, p, mean, cut_large, cut_small. ``rows``: source, size, draw."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sizes = checkpoint_frame(sizes)
    t = targets(sizes, weights, share, most).join(sizes.select(F.col("source").alias("s2"), "docs"), F.expr("source <=> s2")).drop("s2")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = checkpoint_frame(t.withColumn("certain", F.floor(copies + 1e-12).cast("long")).withColumn("p", F.greatest(copies - F.col("certain"), F.lit(0.0)))
                         .withColumn("mean", F.col("source_size") / F.col("docs")).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    own = rows.join(t.select(F.col("source").alias("s2"), "key", "mean", "p"), F.expr("source <=> s2")).where("p > 0").select(
        "key", rank(F.col("draw"), F.col("p")).alias("place"), "size", (F.col("size") > F.col("mean")).alias("large"))
    big = own.where("large")
    want = big.groupBy("key").agg(F.sum("size").alias("words")).join(t.select("key", "p"), "key").select("key", (F.col("words") * F.col("p")).alias("want"))
    first = checkpoint_frame(_cut(big.select("key", "place", "size"), want))
    goal = t.where("p > 0").select("key", (F.col("target") - F.col("certain") * F.col("source_size")).alias("rest")).join(first, "key", "left").select(
        "key", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("want"))
    second = checkpoint_frame(_cut(own.where("NOT large").select("key", "place", "size"), goal))
    return t.join(first.select("key", F.col("cut").alias("cut_large")), "key", "left").join(second.select("key", F.col("cut").alias("cut_small")), "key", "left").select(
        "source", "source_size", "target", "certain", "p", "mean", F.coalesce("cut_large", F.lit(0).cast("long")).alias("cut_large"), F.coalesce("cut_small", F.lit(0).cast("long")).alias("cut_small"))


def _copies(size: Column, u: Column, prefix: str = "") -> Column:
    """Copies of a document by the plan's columns, which carry ``prefix``: the certain ones and the drawn one."""
    certain, p, mean, large, small = (F.col(prefix + c) for c in ("certain", "p", "mean", "cut_large", "cut_small"))
    drawn = F.when((p > 0) & (rank(u, p) < F.when(size > mean, large).otherwise(small)), 1).otherwise(0)
    return F.when(size > 0, certain + drawn).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and draw of every row, written once to the shared folder."""
    source = F.col("source").cast("string")
    return checkpoint_frame(docs.select("doc_id", source.alias("source"), word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), source, F.col("text")).alias("draw")))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Null and empty texts have size 0 and no copies; null sources are one source; a source of size 0 has target 0. Rows
    equal in id, source and text share one draw and are taken or left together. An empty table gives no rows. No document
    has more than ``most`` copies (rounded up).
    """
    rows = measured(docs)
    found = plan(rows, weights, share, most)
    out = rows.join(found.withColumnRenamed("source", "s2"), F.expr("source <=> s2"))
    return out.withColumn("copies", _copies(F.col("size"), F.col("draw"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def materialise(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, small: int = 100_000) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies.

    The plan holds one row per source; it is broadcast when it has at most ``small`` rows and joined by a shuffle otherwise.
    """
    own = fresh_name("mix", docs)
    found = plan(measured(docs), weights, share, most)
    found = checkpoint_frame(found.select([F.col(c).alias(f"{own}{c}") for c in ("source", "certain", "p", "mean", "cut_large", "cut_small")]))
    side = F.broadcast(found) if found.count() <= small else found
    source = docs["source"].cast("string")
    copies = _copies(word_count(docs["text"]), draw(docs["doc_id"], source, docs["text"]), own).cast("int")
    return (
        docs.join(side, source.eqNullSafe(F.col(f"{own}source"))).withColumn(f"{own}copies", copies).where(F.col(f"{own}copies") > 0)
        .withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies")))).select(docs.columns)
    )
