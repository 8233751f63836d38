"""Catalog meaning, features, segments, drivers, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions import lookups as L
from tallyforge.operators import catalog as CA, features as FE, forecast as FO, models as MO
from tallyforge.queries.base import VIEWS, Tables, query, sql
from tallyforge.session import checkpoint_frame

# Header names that orders are taken to describe: (name, data type).
HEADERS = [
    ("order_id", "number"), ("Customer Name", "text"), ("order_date", "time"), ("total_amount", "number"),
    ("product_category", "text"), ("unit_price", "number"), ("discount_rate", "number"), ("store_city", "text"),
    ("employee_salary", "number"), ("hire_date", "time"), ("patient_claim", "text"), ("diagnosis_code", "text"),
    ("account_balance", "number"), ("transaction_time", "time"), ("campaign_clicks", "number"), ("channel", "text"),
    ("stock_on_hand", "number"), ("shipment_route", "text"), ("machine_downtime", "number"), ("profit_margin", "number"),
    ("review_score", "number"), ("region", "text"), ("notes", "text"), ("quantity", "number"),
]
_N = len(HEADERS)


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS["catalog"] = ([], f"""
    SELECT DISTINCT o_custkey AS dataset_id, {_texts(h[0] for h in HEADERS)}[1 + o_orderkey % {_N}] AS column_name,
           (o_orderkey % {_N})::INT AS position, {_texts(h[1] for h in HEADERS)}[1 + o_orderkey % {_N}] AS data_type FROM orders""")


def catalog(t: Tables) -> DataFrame:
    """Every customer as a data set whose columns follow from the keys of its orders."""
    at = (F.col("o_orderkey") % _N).cast("int")
    names, kinds = (F.array(*[F.lit(h[i]) for h in HEADERS]) for i in (0, 1))
    return t.orders.select(
        F.col("o_custkey").alias("dataset_id"), names[at].alias("column_name"), at.alias("position"), kinds[at].alias("data_type")
    ).distinct()


def keyword_rows(table: dict[str, list[str]]) -> str:
    rows = [f"('{d}', {i}, '{w}')" for i, (d, words) in enumerate(table.items()) for w in words]
    return f"(VALUES {', '.join(rows)}) w(name, o, word)"


_LOW = "replace(lower(column_name), '_', ' ')"


@query("prf24_find_roles", sql("catalog", f"""
    SELECT DISTINCT dataset_id, column_name, name AS role FROM catalog, {keyword_rows(L.ROLE_KEYWORDS)} WHERE contains({_LOW}, word)"""))
def prf24(spark, sf):
    return CA.find_roles(catalog(Tables(spark, sf)))


def _choice_sql(kind: str, roles: list[str]) -> str:
    ranks = ", ".join(f"('{r}', {i})" for i, r in enumerate(roles))
    return f"""(SELECT dataset_id, arg_min(column_name, struct_pack(a := coalesce(rank, {len(roles)}), b := position)) AS c FROM (
        SELECT dataset_id, column_name, position, min(p.rank) AS rank FROM catalog LEFT JOIN r USING (dataset_id, column_name)
        LEFT JOIN (VALUES {ranks}) p(role, rank) ON p.role = r.role WHERE data_type = '{kind}' GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("prf25_choose_columns", sql("catalog", f"""
    , r AS (SELECT DISTINCT dataset_id, column_name, name AS role FROM catalog, {keyword_rows(L.ROLE_KEYWORDS)} WHERE contains({_LOW}, word))
    SELECT d.dataset_id, m.c AS measure, x.c AS dimension, t.c AS time FROM (SELECT DISTINCT dataset_id FROM catalog) d
    LEFT JOIN {_choice_sql('number', L.MEASURE_PRIORITY)} m USING (dataset_id) LEFT JOIN {_choice_sql('text', L.DIMENSION_PRIORITY)} x USING (dataset_id)
    LEFT JOIN (SELECT dataset_id, arg_min(column_name, struct_pack(a := (data_type <> 'time')::INT, b := position)) AS c FROM catalog
               WHERE data_type = 'time' OR regexp_matches(lower(column_name), 'date|time|created') GROUP BY 1) t USING (dataset_id)"""))
def prf25(spark, sf):
    return CA.choose_columns(catalog(Tables(spark, sf)))


def _score_sql(table: dict[str, list[str]], boosts: str, catalog: str = "catalog") -> str:
    names = ", ".join(f"('{d}', {i})" for i, d in enumerate(table))
    return f"""
    , h AS (SELECT dataset_id, name, count(*) AS hits FROM {catalog}, {keyword_rows(table)} WHERE contains({_LOW}, word) GROUP BY 1, 2)
    , f AS (SELECT dataset_id, bool_or(data_type = 'number') AS num, bool_or(data_type = 'time') AS tim, count(*) FILTER (WHERE data_type = 'text') AS txt,
                   bool_or(regexp_matches(lower(column_name), 'patient|claim')) AS care, bool_or(regexp_matches(lower(column_name), 'employee|salary')) AS staff,
                   bool_or(regexp_matches(lower(column_name), 'date|time')) AS dated, bool_or(regexp_matches(lower(column_name), 'product|category|sku')) AS goods,
                   bool_or(regexp_matches(lower(column_name), 'amount|balance|transaction')) AS money FROM {catalog} GROUP BY 1)
    , s AS (SELECT f.dataset_id, d.name, d.o, coalesce(h.hits, 0) + {boosts} AS score FROM f CROSS JOIN (VALUES {names}) d(name, o)
            LEFT JOIN h ON h.dataset_id = f.dataset_id AND h.name = d.name)
    , n AS (SELECT *, sum(score) OVER (PARTITION BY dataset_id) AS total FROM s)
    , q AS (SELECT *, CASE WHEN total > 0 THEN round(score / total, 4) END AS share FROM n)
    , k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY share DESC, o) AS i FROM q)"""


def _domain_sql(table: dict[str, list[str]], boosts: str, fallback: str) -> str:
    return sql("catalog", _score_sql(table, boosts) + f"""
    SELECT dataset_id, CASE WHEN total > 0 THEN name ELSE 'generic' END AS domain, CASE WHEN total > 0 THEN share ELSE {fallback} END AS confidence FROM k WHERE i = 1""")


_BOOSTS = """
    CASE WHEN num AND tim AND d.name IN ('sales', 'finance', 'logistics', 'marketing') THEN 0.25e0 ELSE 0e0 END
    + CASE WHEN care AND d.name = 'healthcare' THEN 0.75e0 ELSE 0e0 END + CASE WHEN staff AND d.name = 'hr' THEN 0.75e0 ELSE 0e0 END"""


def domain_sql(views: str, catalog: str) -> str:
    """The views and the steps up to ``k``, which ranks the domains of every data set of ``catalog``."""
    return sql(views, _score_sql(L.DOMAIN_KEYWORDS, _BOOSTS, catalog))


@query("prf26_classify_domain", _domain_sql(L.DOMAIN_KEYWORDS, _BOOSTS, "0.35e0"))
def prf26(spark, sf):
    return CA.classify_domain(catalog(Tables(spark, sf))).drop("scores")


@query("prf27_infer_domain", _domain_sql(L.INDUSTRY_KEYWORDS, """
    CASE WHEN dated AND num THEN CASE d.name WHEN 'sales' THEN 0.5e0 WHEN 'operations' THEN 0.25e0 ELSE 0e0 END ELSE 0e0 END
    + CASE WHEN txt >= 2 AND goods THEN CASE d.name WHEN 'retail' THEN 0.75e0 WHEN 'ecommerce' THEN 0.5e0 ELSE 0e0 END ELSE 0e0 END
    + CASE WHEN money AND d.name IN ('finance', 'banking') THEN 0.4e0 ELSE 0e0 END""", "1e0"))
def prf27(spark, sf):
    return CA.infer_domain(catalog(Tables(spark, sf))).drop("scores")


# ---------------------------------------------------------------- features

@query("ml1_impute_median", sql("holed", """
    SELECT order_id, round(coalesce(quantity, (SELECT median(quantity) FROM holed)), 4) AS quantity,
           round(coalesce(discount, (SELECT median(discount) FROM holed)), 4) AS discount FROM holed"""))
def ml1(spark, sf):
    h = Tables(spark, sf).holed.select("order_id", "quantity", "discount")
    return FE.impute_median(h, ["quantity", "discount"])


@query("ml1_impute_by_group", sql("holed", """
    , g AS (SELECT region, median(quantity) AS q, median(discount) AS d FROM holed WHERE region IS NOT NULL GROUP BY 1)
    SELECT order_id, region, coalesce(quantity, q, (SELECT median(quantity) FROM holed)) AS quantity,
           coalesce(discount, d, (SELECT median(discount) FROM holed)) AS discount FROM holed LEFT JOIN g USING (region)"""))
def ml1b(spark, sf):
    h = Tables(spark, sf).holed.select("order_id", "region", "quantity", "discount")
    return FE.impute_by_group(h, ["quantity", "discount"], "region")


VIEWS["holed_customers"] = ([], """
    SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 7 <> 0 THEN n::DOUBLE END AS orders,
           CASE WHEN c_custkey % 11 <> 0 THEN top END AS largest
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) ON c_custkey = o_custkey""")


def holed_customers(t: Tables) -> DataFrame:
    """Balance, number of orders and largest order of every customer, with holes by key and where there are no orders."""
    made = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("o_totalprice").alias("top"))
    k = F.col("c_custkey")
    return t.customer.join(made, "c_custkey", "left").select(
        k.alias("customer_id"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 7 != 0, F.col("n")).alias("orders"),
        F.when(k % 11 != 0, F.col("top")).alias("largest"))


_FEATURES = ["balance", "orders", "largest"]
_SHARED = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in _FEATURES)
_SQUARES = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0e0)" for c in _FEATURES)


def _nearest_sql(c: str) -> str:
    return f"""(SELECT customer_id, avg(value) AS value FROM (
        SELECT a.customer_id, b.{c} AS value, row_number() OVER (PARTITION BY a.customer_id ORDER BY sqrt({_SQUARES}) * sqrt(3e0 / ({_SHARED})), b.{c}) AS i
        FROM holed_customers a JOIN holed_customers b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND {_SHARED} > 0) WHERE i <= 5 GROUP BY 1) {c}_near"""


@query("ml1_impute_nearest", sql("holed_customers", f"""
    SELECT h.customer_id, {', '.join(f"round(coalesce(h.{c}, {c}_near.value, (SELECT avg({c}) FROM holed_customers)), 4) AS {c}" for c in _FEATURES)}
    FROM holed_customers h {' '.join(f"LEFT JOIN {_nearest_sql(c)} ON {c}_near.customer_id = h.customer_id" for c in _FEATURES)}"""))
def ml1c(spark, sf):
    from tallyforge.operators.nearest_impute import impute_nearest

    filled = impute_nearest(holed_customers(Tables(spark, sf)), _FEATURES)
    return filled.select("customer_id", *[F.round(c, 4).alias(c) for c in _FEATURES])


@query("ml2_standardize", sql("user_features", """
    SELECT user_id, round((events - avg(events) OVER ()) / stddev_pop(events) OVER (), 6) AS events_scaled,
           round((total - avg(total) OVER ()) / stddev_pop(total) OVER (), 6) AS total_scaled FROM user_features"""))
def ml2(spark, sf):
    scaled = FE.standardize(Tables(spark, sf).user_features, ["events", "total"])
    return scaled.select("user_id", F.round("events_scaled", 6).alias("events_scaled"), F.round("total_scaled", 6).alias("total_scaled"))


@query("ml3_one_hot_top6", """
    SELECT event_id, (coalesce(event_type, 'Unknown') = 'click')::INT AS event_type_click, (coalesce(event_type, 'Unknown') = 'error')::INT AS event_type_error,
           (coalesce(event_type, 'Unknown') = 'purchase')::INT AS event_type_purchase, (coalesce(event_type, 'Unknown') = 'signup')::INT AS event_type_signup,
           (event_type IS NULL OR event_type = 'Unknown')::INT AS event_type_Unknown
    FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events)""")
def ml3(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    return FE.one_hot_top(e, ["event_type"]).drop("event_type")


# ---------------------------------------------------------------- segments and drivers

_USER = ["events", "total", "mean", "top"]


@query("ml5_kmeans_segments")
def ml5(spark, sf):
    segments, quality = MO.kmeans_segments(Tables(spark, sf).user_features, _USER, ["user_id"])
    score = quality.select("confidence_score").scalar()
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("size")).withColumn("confidence_score", score)


@query("ml6_segment_profile", sql("user_features", """
    , l AS (SELECT *, user_id % 3 AS segment FROM user_features)
    , m AS (""" + " UNION ALL ".join(f"SELECT segment, '{c}' AS \"column\", avg({c}) - (SELECT avg({c}) FROM l) AS delta, count(*) AS size FROM l GROUP BY 1" for c in _USER) + """)
    , k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(delta) DESC, "column") AS rank FROM m)
    SELECT segment, size, round(size * 100e0 / (SELECT count(*) FROM l), 2) AS share_percent, rank::INT AS rank, "column", round(delta, 4) AS delta FROM k WHERE rank <= 2"""))
def ml6(spark, sf):
    labelled = Tables(spark, sf).user_features.withColumn("segment", F.col("user_id") % 3)
    return MO.segment_profile(labelled, _USER, top=2)


@query("ml7_driver_importance")
def ml7(spark, sf):
    return MO.driver_importance(Tables(spark, sf).sales, ["revenue", "quantity", "discount", "cost"])


# ---------------------------------------------------------------- forecasts

def _fit_sql(keys: str) -> str:
    return f"""
    , f AS (SELECT {keys}, count(y) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(greatest(regr_syy(y, x) * (1 - regr_r2(y, x)), 0) / (count(y) - 1)) AS s,
                   max(start) AS last, max(x) AS lx, arg_max(y, x) AS cur FROM p GROUP BY {keys})"""


_DAYS = """
    , p AS (SELECT 'revenue' AS measure, start, revenue AS y, (row_number() OVER (ORDER BY start) - 1)::DOUBLE AS x FROM daily
            UNION ALL SELECT 'quantity', start, quantity, (row_number() OVER (ORDER BY start) - 1)::DOUBLE FROM daily)"""


@query("ml8_linear_forecast", sql("daily", _DAYS + _fit_sql("measure") + """
    SELECT measure, step::INT AS step, strftime(last + to_days(step::INT), '%Y-%m-%d') AS period, round(a + b * (lx + step), 2) AS forecast,
           round(a + b * (lx + step) - 1.96e0 * s, 2) AS lower, round(a + b * (lx + step) + 1.96e0 * s, 2) AS upper FROM f, range(1, 31) t(step)"""))
def ml8(spark, sf):
    found = FO.forecast(Tables(spark, sf).sales, "order_date", ["revenue", "quantity"])
    return found.select("measure", "step", F.date_format("period", "yyyy-MM-dd").alias("period"), *[F.round(c, 2).alias(c) for c in ("forecast", "lower", "upper")])


def _points(spark, sf) -> DataFrame:
    return FO.daily_points(Tables(spark, sf).sales, "order_date", ["revenue", "quantity"])


# per tree the nearest drawn day; draws are a hash of draw and tree number
_FOREST = """
    , t AS (SELECT unnest(range(80))::BIGINT AS t)
    , q AS (SELECT measure, start, x::BIGINT AS x, y, count(*) OVER (PARTITION BY measure) AS n FROM p)
    , d1 AS (SELECT measure, t, x, n, (x * 48271 + t * 1299709 + 97) % 2147483647 AS r FROM q, t)
    , d2 AS (SELECT measure, t, x, n, (r * r + t + 12345) % 2147483647 AS r FROM d1)
    , d3 AS (SELECT DISTINCT measure, t, (r * r + x) % 2147483647 % n AS drawn FROM d2)
    , g AS (SELECT q.measure, t.t, q.x, d3.drawn FROM q CROSS JOIN t LEFT JOIN d3 ON d3.measure = q.measure AND d3.t = t.t AND d3.drawn = q.x)
    , w AS (SELECT *, max(drawn) OVER (PARTITION BY measure, t ORDER BY x) AS lo,
                   min(drawn) OVER (PARTITION BY measure, t ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM g)
    , z AS (SELECT measure, t, x, CASE WHEN hi IS NULL OR x - lo <= hi - x THEN lo ELSE hi END AS near FROM w)
    , e AS (SELECT z.measure, z.x, avg(q.y) AS fit FROM z JOIN q ON q.measure = z.measure AND q.x = z.near GROUP BY 1, 2)
    , m AS (SELECT measure, avg(y) AS m FROM q GROUP BY 1)
    , s AS (SELECT measure, greatest(0e0, least(1e0, 1 - sum((y - fit) * (y - fit)) / sum((y - m) * (y - m)))) AS conf, arg_max(y, x) AS cur, max(start) AS last
            FROM q JOIN e USING (measure, x) JOIN m USING (measure) GROUP BY 1)
    , v AS (SELECT l.measure, avg(q.y) AS v FROM (SELECT measure, t, max(drawn) AS drawn FROM d3 GROUP BY 1, 2) l JOIN q ON q.measure = l.measure AND q.x = l.drawn GROUP BY 1)"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("measure", "model", "step", F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("current_value", 2).alias("current_value"),
                        F.round("predicted_value", 2).alias("predicted_value"), F.round("confidence", 6).alias("confidence"))


@query("ml9_forest_forecast", sql("daily", _DAYS + _FOREST + """
    SELECT measure, 'Random Forest' AS model, step::INT AS step, strftime(last + to_days(step::INT), '%Y-%m-%d') AS period, round(cur, 2) AS current_value,
           round(v, 2) AS predicted_value, round(conf, 6) AS confidence FROM s JOIN v USING (measure), range(1, 31) t(step)"""))
def ml9(spark, sf):
    return _shown(FO.tree_forecast(_points(spark, sf), "forest"))


@query("ml10_boosted_forecast")
def ml10(spark, sf):
    return _shown(FO.tree_forecast(_points(spark, sf), "boosted"))


# The boosted candidate's value is no SQL; its confidence is fixed, so its row stands with a null, which shows if it were chosen.
@query("ml11_select_forecast", sql("daily", _DAYS + _fit_sql("measure") + _FOREST + """
    , c AS (SELECT measure, 'Gradient Boosted Trees' AS model, cur AS c, NULL AS v, 0.78e0 AS conf, 1 AS turn FROM f
            UNION ALL SELECT measure, 'Random Forest', cur, v, conf, 2 FROM s JOIN v USING (measure)
            UNION ALL SELECT measure, 'Linear trend fallback', cur, a + b * (lx + 30), 0.58e0, 3 FROM f)
    , k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY conf DESC, turn) AS i FROM c)
    SELECT measure, model, round(c, 2) AS current_value, round(v, 2) AS predicted_value, round((v - c) / abs(c) * 100, 2) AS change_percent,
           round(conf * 100)::BIGINT AS confidence_score FROM k WHERE i = 1"""))
def ml11(spark, sf):
    return FO.select_forecast(FO.forecast_candidates(checkpoint_frame(_points(spark, sf))))


@query("ml12_tree_forecast_many")
def ml12_trees(spark, sf):
    """The forest forecast of every supplier's series, in one grouped job."""
    points = FO.daily_points(Tables(spark, sf).supplier_lines, "ship_date", ["quantity"], ["dataset_id"])
    found = FO.tree_forecast(points, "forest", by=["dataset_id"])
    return found.select("dataset_id", "step", F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("predicted_value", 4).alias("forecast"), F.round("confidence", 6).alias("confidence"))


@query("ml12_forecast_many", sql("supplier_lines", """
    , d AS (SELECT dataset_id, date_trunc('day', ship_date)::TIMESTAMP AS start, sum(quantity) AS v FROM supplier_lines GROUP BY 1, 2)
    , b AS (SELECT dataset_id, unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM d GROUP BY 1)
    , p AS (SELECT dataset_id, start, coalesce(v, 0) AS y, (row_number() OVER (PARTITION BY dataset_id ORDER BY start) - 1)::DOUBLE AS x FROM b LEFT JOIN d USING (dataset_id, start))
    """ + _fit_sql("dataset_id") + """
    SELECT dataset_id, step::INT AS step, strftime(last + to_days(step::INT), '%Y-%m-%d') AS period, round(a + b * (lx + step), 4) AS forecast FROM f, range(1, 31) t(step)"""))
def ml12(spark, sf):
    found = FO.forecast(Tables(spark, sf).supplier_lines, "ship_date", ["quantity"], ["dataset_id"])
    return found.select("dataset_id", "step", F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("forecast", 4).alias("forecast"))
