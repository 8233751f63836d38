"""Forecasts of daily series: least squares in one shuffle, tree models of all series in one grouped job, model choice."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyforge.functions import series_trees
from tallyforge.functions.semantics import col, growth
from tallyforge.operators import backbone as B

HORIZON = 30


def daily_points(df: DataFrame, time: str, measures: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., measure, start, x, y): one row per day and measure with its 0-based position.

    The window runs on daily sums, partitioned by series; its partitions are kept for whoever groups by series.
    """
    by = list(by)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), col(m).alias("y")) for m in measures])
    return B.time_series(df, time, measures, "D", by, "_x").select(*by, "start", F.inline(each), F.col("_x").alias("x"))


def row_points(df: DataFrame, measure: str, position: str) -> DataFrame:
    """Points for a table without time: a 0-based row position must be given."""
    return df.where(col(measure).isNotNull()).select(
        F.lit(measure).alias("measure"), col(position).cast("double").alias("x"), col(measure).cast("double").alias("y"),
        F.lit(None).cast("timestamp").alias("start"),
    )


def linear_fit(points: DataFrame, by: list[str] = (), min_points: int = 5) -> DataFrame:
    """Slope, intercept, residual deviation and last value of every series, in one aggregation."""
    keys = [*by, "measure"]
    fitted = points.groupBy(*keys).agg(
        F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_syy("y", "x").alias("syy"), F.coalesce(F.regr_r2("y", "x"), F.lit(1.0)).alias("r2"),
        F.max("start").alias("last"), F.max_by("y", "x").alias("current"), F.max("x").alias("last_x"),
    )
    sse = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    return fitted.where(F.col("n") >= min_points).withColumn("residual_std", F.sqrt(sse / (F.col("n") - 1)))


def linear_forecast(points: DataFrame, by: list[str] = (), steps: int | None = HORIZON) -> DataFrame:
    """(by..., measure, step, period, forecast, lower, upper) with a 95 % band.

    ``steps=None`` uses a quarter of the history, between 7 and 30.
    """
    fitted = linear_fit(points, by)
    horizon = F.lit(steps) if steps else F.greatest(F.lit(7), F.least(F.lit(30), F.floor(F.col("n") / 4))).cast("int")
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), horizon)))
    value = F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("step"))
    band = F.lit(1.96) * F.col("residual_std")
    return ahead.select(
        *by, "measure", "step", F.date_add(F.col("last").cast("date"), F.col("step")).alias("period"),
        value.alias("forecast"), (value - band).alias("lower"), (value + band).alias("upper"),
    )


def linear_candidates(points: DataFrame, by: list[str] = (), steps: int = HORIZON) -> DataFrame:
    """(by..., measure, model, current_value, predicted_value, confidence) of the fallback model."""
    fitted = linear_fit(points, by, min_points=8)
    return fitted.select(
        *by, "measure", F.lit("Linear trend fallback").alias("model"), F.col("current").alias("current_value"),
        (F.col("intercept") + F.col("slope") * (F.col("last_x") + steps)).alias("predicted_value"),
        F.lit(0.58).alias("confidence"),
    )


MODELS = {"boosted": "Gradient Boosted Trees", "forest": "Random Forest"}


def tree_forecast(points: DataFrame, model: str = "forest", steps: int = HORIZON, trees: int = 80, by: list[str] = ()) -> DataFrame:
    """(by..., measure, model, step, period, current_value, predicted_value, confidence): trees on the time index of every series.

    ``forest`` is a bootstrap forest without limit of depth, its confidence the in-sample R2; ``boosted`` has ``trees`` rounds of
    gradient boosting and a confidence of 0.78. All series are fitted in one grouped job: a series is already aggregated to days, so
    it is one row with a calendar of values, however many rows a day has, and series of one length share the draws of their forests. Series of fewer than 8 points have no forecast; beyond the last day a tree
    answers with its last leaf, so all steps are equal.
    """
    own, name = [*by, "measure"], MODELS[model]
    # keys are carried by names of their own, so that no column of the caller can clash
    keys = {k: f"_key{i}" for i, k in enumerate(own)}
    known = points.where(F.col("y").isNotNull()).select(
        *[col(k).alias(v) for k, v in keys.items()], F.col("start").cast("timestamp").alias("start"),
        F.struct(F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))).alias("x"), F.col("y").cast("double").alias("y")).alias("point"))
    series = known.groupBy(*keys.values()).agg(
        F.max("start").alias("last"), F.transform(F.sort_array(F.collect_list("point")), lambda p: p["y"]).alias("ys")).where(F.size("ys") >= 8)

    @F.pandas_udf("current_value double, predicted_value double, confidence double")
    def fit(ys: pd.Series) -> pd.DataFrame:
        grown = series_trees.forests(ys.tolist(), trees) if model == "forest" else [(series_trees.boosted(y, trees)[-1], 0.78) for y in ys]
        return pd.DataFrame([(y[-1], *g) for y, g in zip(ys, grown)], columns=["current_value", "predicted_value", "confidence"])

    fitted = series.select(*keys.values(), "last", fit("ys").alias("fit"))
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(
        *[F.col(v).alias(k) for k, v in keys.items()], F.lit(name).alias("model"), "step", F.date_add(F.col("last").cast("date"), F.col("step")).alias("period"),
        "fit.*")


def forecast_candidates(points: DataFrame, steps: int = HORIZON, trees: int = 80, by: list[str] = ()) -> DataFrame:
    """(by..., measure, model, current_value, predicted_value, confidence) of the boosted, forest and linear models after ``steps`` days."""
    columns = [*by, "measure", "model", "current_value", "predicted_value", "confidence"]
    grown = [tree_forecast(points, model, steps, trees, by).where(F.col("step") == steps) for model in MODELS]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in [*grown, linear_candidates(points, by, steps)]])


def select_forecast(candidates: DataFrame, by: list[str] = ()) -> DataFrame:
    """The candidate with the highest confidence per series (boosted before forest before others on ties) and its change against the last value."""
    keys = [*by, "measure"]
    turn = F.coalesce(F.array_position(F.lit(list(MODELS.values())), F.col("model")), F.lit(0))
    turn = F.when(turn > 0, -turn).otherwise(-9)
    best = F.max_by(F.struct("model", "current_value", "predicted_value", "confidence"), F.struct("confidence", turn, "model"))
    chosen = candidates.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    return chosen.select(
        *keys, "model", F.round("current_value", 2).alias("current_value"), F.round("predicted_value", 2).alias("predicted_value"),
        growth(F.col("predicted_value"), F.col("current_value")).alias("change_percent"),
        F.round(F.col("confidence") * 100).cast("long").alias("confidence_score"),
    )


def forecast(df: DataFrame, time: str, measures: list[str], by: list[str] = (), steps: int = HORIZON) -> DataFrame:
    """The least-squares forecast of every (group, measure) series at once."""
    return linear_forecast(daily_points(df, time, measures, by), by, steps)
