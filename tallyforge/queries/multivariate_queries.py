"""Unusual rows over several columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import multivariate as M
from tallyforge.queries.base import Tables, query, sql

_USER = ["events", "total", "mean", "top"]
_SCALED = ", z AS (SELECT user_id, " + ", ".join(f"(({c}) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _USER) + " FROM user_features)"
_GAP = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in _USER) + ")"


@query("anm5_isolation_forest")
def anm5(spark, sf):
    users = Tables(spark, sf).user_features
    return M.summarize(users, "user_id", _USER, M.isolation_forest(users, "user_id", _USER), "Isolation Forest")


@query("anm6_local_outlier_factor", sql("user_features", _SCALED + f"""
    , d AS (SELECT a.user_id AS p, b.user_id AS o, {_GAP} AS gap FROM z a JOIN z b ON a.user_id <> b.user_id)
    , k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY gap) AS i FROM d) WHERE i <= 20)
    , h AS (SELECT p, max(gap) AS kd FROM k GROUP BY 1)
    , l AS (SELECT k.p, 1 / (avg(greatest(gap, kd)) + 1e-10) AS lrd FROM k JOIN h ON h.p = k.o GROUP BY 1)
    SELECT k.p AS user_id, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM k JOIN l b ON b.p = k.o JOIN l a ON a.p = k.p GROUP BY 1"""))
def anm6(spark, sf):
    found = M.local_outlier_factor(Tables(spark, sf).user_features, "user_id", _USER, 20)
    return found.select("user_id", F.round("lof", 6).alias("lof"))


@query("anm7_density_noise", sql("user_features", _SCALED + f"""
    , d AS (SELECT a.user_id AS p, b.user_id AS o FROM z a JOIN z b ON {_GAP} <= 0.9e0)
    , c AS (SELECT p FROM d GROUP BY 1 HAVING count(*) >= 8)
    SELECT user_id FROM z WHERE user_id NOT IN (SELECT p FROM d WHERE o IN (SELECT p FROM c))"""))
def anm7(spark, sf):
    return M.density_noise(Tables(spark, sf).user_features, "user_id", _USER, eps=0.9, min_samples=8)
