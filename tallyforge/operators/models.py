"""Segments and drivers with MLlib."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyforge.functions.semantics import col, percent
from tallyforge.operators import features as FE
from tallyforge.operators.anomaly import imputed
from tallyforge.session import checkpoint_frame, staged_table

# Rows of one task of an iterative fit, and fits that run at once: a fit has some forty jobs, which are short on few tasks.
_TASK_ROWS = 20_000
_AT_ONCE = 5
# A forest takes its rows as they are up to this many; beyond, rows of equal bins are added up to about this many.
FOREST_ROWS = 200_000
_BINS = 32


def _numbers(df: DataFrame, columns: list[str], keep: list[str] = ()) -> tuple[DataFrame, int, list[str]]:
    """(the columns alone, written once, since the steps of a fit read them many times; rows; columns that hold NULLs)."""
    table = staged_table(df.select(*[col(c) for c in dict.fromkeys([*keep, *columns])]))
    found = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return table, found["rows"], [c for i, c in enumerate(columns) if found[f"n{i}"] < found["rows"]]


def kmeans_segments(
    df: DataFrame, columns: list[str], keep: list[str] = (), max_k: int = 5, restarts: int = 10, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``segment``, one-row quality). Segments are numbered by size, largest first.

    k-means|| on standardised, median-imputed columns; the restart with the lowest cost wins.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    columns = columns[:limit]
    table, rows, holes = _numbers(df, columns, keep)
    if rows < 10 or len(columns) < 2:
        raise ValueError("Segmentation requires at least 10 rows and two numeric measures.")
    k = min(max_k, max(2, rows // 25))
    matrix = imputed(table, columns, keep, holes)
    scaled = FE.standardize(matrix, columns, limit)
    vectors = VectorAssembler(inputCols=[f"{c}_scaled" for c in columns], outputCol="features").transform(scaled)
    vectors = vectors.select(*[col(x) for x in keep], *columns, "features").repartition(1 + rows // _TASK_ROWS)
    vectors = checkpoint_frame(vectors.sortWithinPartitions(*[col(x) for x in (*columns, *keep)])).persist()
    vectors.count()
    with ThreadPool(min(_AT_ONCE, restarts)) as pool:
        fit = inheritable_thread_target(df.sparkSession)(lambda i: KMeans(k=k, seed=42 + i, maxIter=50).fit(vectors))
        models = pool.map(fit, range(restarts), chunksize=1)
    best = min(models, key=lambda m: m.summary.trainingCost)
    labelled = best.transform(vectors)
    silhouette = ClusteringEvaluator().evaluate(labelled)
    vectors.unpersist()
    order = sorted(range(len(best.summary.clusterSizes)), key=lambda i: (-best.summary.clusterSizes[i], i))
    number = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    segments = labelled.withColumn("segment", number[F.col("prediction")]).drop("features", "prediction")
    score = int(round(max(0.0, min(1.0, (silhouette + 1) / 2)) * 100))
    quality = df.sparkSession.createDataFrame([(k, score)], "segments int, confidence_score int")
    return segments, quality


def segment_profile(labelled: DataFrame, columns: list[str], top: int = 4, segment: str = "segment") -> DataFrame:
    """(segment, size, share, rank, column, delta): where a segment's mean differs most from the overall mean."""
    overall = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    packed = overall.select(F.struct(*overall.columns).alias("o")).scalar()
    means = labelled.groupBy(segment).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    ).withColumn("o", packed)
    long = means.select(
        segment, "size", percent(F.col("size"), F.col("o.n"), 2).alias("share_percent"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), (F.col(f"s{i}") - F.col(f"o.m{i}")).alias("delta")) for i, c in enumerate(columns)
        ])),
    )
    # A handful of segments x columns.
    rank = F.row_number().over(W.partitionBy(segment).orderBy(F.desc(F.abs("delta")), F.asc("column")))
    return long.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("delta", F.round("delta", 4))


def _by_bins(filled: DataFrame, target: str, names: list[str], most: int) -> DataFrame:
    """(features, label, weight, within): all rows, those of equal bins added up to about ``most`` weighted rows.

    A forest sees a number only as one of 32 bins, and the gain of a split follows from the counts and means of the bins. So
    rows with equal bins count as one of their weight and mean label. A bin holds several such rows, dealt by a hash of the
    values, so that trees still draw different ones. ``within`` is what the label varies inside, as a sum of squares.
    """
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    probs = [k / _BINS for k in range(1, _BINS)]
    found = filled.agg(*[F.percentile_approx(col(c), probs, 10000).alias(f"q{i}") for i, c in enumerate(names)]).first()
    cuts = [[-float("inf"), *sorted({q for q in found[f"q{i}"] if abs(q) < float("inf")} or {0.0}), float("inf")] for i in range(len(names))]
    plain = filled.select(*[col(c).alias(f"x{i}") for i, c in enumerate(names)], col(target).alias("y"))
    bins = [f"b{i}" for i in range(len(names))]
    cut = Bucketizer(splitsArray=cuts, inputCols=[f"x{i}" for i in range(len(names))], outputCols=bins, handleInvalid="keep").transform(plain)
    slices = max(1, most // cut.select(*bins).distinct().count())
    dealt = cut.withColumn("slice", F.pmod(F.xxhash64(*plain.columns), F.lit(slices)))
    added = dealt.groupBy(*bins, "slice").agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.avg("y").alias("label"), (F.var_pop("y") * F.count(F.lit(1))).alias("within"))
    return VectorAssembler(inputCols=bins, outputCol="features").transform(added).select("features", "label", "weight", "within").repartition(1 + most // _TASK_ROWS)


def driver_importance(df: DataFrame, columns: list[str], trees: int = 80, limit: int | None = None) -> DataFrame:
    """(rank, feature, importance, target, confidence_score): which numbers predict the first one."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    columns = columns[:limit]
    table, rows, holes = _numbers(df, columns)
    if len(columns) < 2 or rows < 20:
        raise ValueError("Driver analysis requires at least 20 rows and two numeric fields.")
    target, names = columns[0], columns[1:]
    filled = imputed(table, columns, holes=holes)
    forest = RandomForestRegressor(numTrees=trees, seed=42, maxDepth=30)
    if rows <= FOREST_ROWS:
        forest.setMinInstancesPerNode(max(1, rows // 100))
        data = VectorAssembler(inputCols=names, outputCol="features").transform(filled).select("features", col(target).alias("label")).persist()
        model = forest.fit(data)
        r2 = RegressionEvaluator(metricName="r2").evaluate(model.transform(data))
    else:
        data = _by_bins(filled, target, names, FOREST_ROWS).persist()
        model = forest.setWeightCol("weight").setMinWeightFractionPerNode(0.01).fit(data)
        # squared errors of all rows: those round the mean of their own weighted row, and those of that mean
        mean = data.agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("m")).first()["m"]
        error, spread = (F.sum(F.col("within") + F.col("weight") * (F.col("label") - x) ** 2) for x in (F.col("prediction"), F.lit(mean)))
        both = model.transform(data).agg(error.alias("error"), spread.alias("spread")).first()
        r2 = 1 - both["error"] / both["spread"] if both["spread"] else 0.0
    data.unpersist()
    score = int(round(min(0.95, max(0.5, r2)) * 100))
    found = sorted(zip(names, model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    out = [(i + 1, n, round(float(v), 4), target, score) for i, (n, v) in enumerate(found)]
    return df.sparkSession.createDataFrame(
        out, "rank int, feature string, importance double, target string, confidence_score int"
    )
