"""Key figures, trends, grouped analysis, anomalies by rule, chart series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyforge.functions.semantics import confidence_percent
from tallyforge.operators import anomaly as A, charts as CH, grouped as G, kpi as K, trend as TR
from tallyforge.queries.base import VIEWS, Tables, query, sql
from tallyforge.queries.profile_queries import NUMBERS, TEXTS, freq_sql, union_sql

VIEWS["daily"] = (["sales"], """
    SELECT d AS start, coalesce(revenue, 0) AS revenue, coalesce(quantity, 0) AS quantity
    FROM (SELECT unnest(generate_series(min(date_trunc('day', order_date)), max(date_trunc('day', order_date)), INTERVAL 1 DAY)) AS d FROM sales)
    LEFT JOIN (SELECT date_trunc('day', order_date)::TIMESTAMP AS d, sum(revenue) AS revenue, sum(quantity) AS quantity FROM sales GROUP BY 1) USING (d)""")
VIEWS["monthly"] = (["daily"], """
    SELECT date_trunc('month', start) AS start, sum(revenue) AS revenue, sum(quantity) AS quantity FROM daily GROUP BY 1""")


# ---------------------------------------------------------------- key figures

@query("kpi1_dynamic_kpis", sql("holed", """
    , k AS (SELECT count(*) AS n, count(quantity) AS q, count(discount) AS d, count(region) AS r FROM holed)
    SELECT 'Quantity Total' AS kpi, (SELECT round(sum(quantity), 2) FROM holed) AS value, 'quantity' AS source, 'sum' AS aggregation,
           round(greatest(0.55e0, least(0.98e0, round(q / n::DOUBLE, 4) ** 2)) * 100)::BIGINT AS confidence FROM k
    UNION ALL SELECT 'Revenue Total', (SELECT round(sum(revenue), 2) FROM holed), 'revenue', 'sum', 98 FROM k
    UNION ALL SELECT 'Discount Total', (SELECT round(sum(discount), 2) FROM holed), 'discount', 'sum',
           round(greatest(0.55e0, least(0.98e0, round(d / n::DOUBLE, 4) ** 2)) * 100)::BIGINT FROM k
    UNION ALL SELECT 'Unique Region', (SELECT count(DISTINCT region) FROM holed), 'region', 'nunique',
           round(greatest(0.55e0, least(0.95e0, round(r / n::DOUBLE, 4))) * 100)::BIGINT FROM k
    UNION ALL SELECT 'Unique Category', (SELECT count(DISTINCT category) FROM holed), 'category', 'nunique', 95 FROM k"""))
def kpi1(spark, sf):
    found = K.dynamic_kpis(Tables(spark, sf).holed)
    return found.select("kpi", "value", F.col("source_columns")[0].alias("source"), "aggregation", "confidence")


_SLOPE = "round(regr_slope({c}, floor(epoch_us({t}) / 1000000) - 946684800) * 86400, 4)"


@query("kpi2_discovered_kpis", sql("sales", """
    , g AS (SELECT count(*) AS n FROM sales GROUP BY order_id, order_date, customer_name, product_name, category, region, quantity, revenue, discount, cost)
    , w AS (SELECT """ + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, "
        f"quantile_cont({c}, 0.75) + 1.5e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi" for c in NUMBERS) + """ FROM sales)
    , o AS (SELECT count(*) FILTER (WHERE """ + " OR ".join(f"{c} < {c}_lo OR {c} > {c}_hi" for c in NUMBERS) + """) AS x, count(*) AS n FROM sales, w)
    """ + freq_sql("sales", TEXTS) + """
    SELECT 'Row Count' AS kpi, (SELECT count(*) FROM sales)::DOUBLE AS value, NULL::VARCHAR AS text
    UNION ALL SELECT 'Column Count', 10, NULL
    UNION ALL SELECT 'Missing %', 0, NULL
    UNION ALL SELECT 'Duplicate %', (SELECT round(sum(n - 1) * 100e0 / sum(n), 4) FROM g), NULL
    UNION ALL SELECT 'Data Health Score', (SELECT round((1 - ((SELECT sum(n - 1) FROM g) / n::DOUBLE * 0.3e0 + x / n::DOUBLE * 0.1e0)) * 100, 4) FROM o), NULL
    UNION ALL """ + " UNION ALL ".join(f"""
    SELECT '{c} {"Total" if c in ("quantity", "revenue") else "Sum"}', (SELECT round(sum({c}), 2) FROM sales), NULL
    UNION ALL SELECT '{c} Average', (SELECT round(avg({c}), 2) FROM sales), NULL
    UNION ALL SELECT '{c} Trend (slope/day)', (SELECT {_SLOPE.format(c=c, t='order_date')} FROM sales), NULL""" for c in NUMBERS) + """
    UNION ALL SELECT 'Top ' || "column", NULL, v FROM r WHERE k = 1
    UNION ALL SELECT 'Top ' || "column" || ' %', round(round(n * 100e0 / t, 4), 2), NULL FROM r WHERE k = 1"""))
def kpi2(spark, sf):
    return K.discovered_kpis(Tables(spark, sf).sales, "order_date")


def _plain(df):
    return df.select("kpi", "value", F.array_join("source_columns", ",").alias("source"), "confidence")


@query("kpi3_role_totals", sql("sales", """
    SELECT 'Revenue' AS kpi, round(sum(revenue), 2) AS value, 'revenue' AS source, 88::BIGINT AS confidence FROM sales
    UNION ALL SELECT 'Cost', round(sum(cost), 2), 'cost', 88 FROM sales
    UNION ALL SELECT 'Units', round(sum(quantity), 2), 'quantity', 88 FROM sales
    UNION ALL SELECT 'Discount', round(sum(discount), 2), 'discount', 88 FROM sales"""))
def kpi3(spark, sf):
    return _plain(K.role_totals(Tables(spark, sf).sales))


@query("kpi4_role_distinct", sql("sales", """
    SELECT 'Orders' AS kpi, count(DISTINCT order_id)::DOUBLE AS value, 'order_id' AS source, 82::BIGINT AS confidence FROM sales
    UNION ALL SELECT 'Customers', count(DISTINCT customer_name), 'customer_name', 82 FROM sales
    UNION ALL SELECT 'Products', count(DISTINCT product_name), 'product_name', 82 FROM sales
    UNION ALL SELECT 'Categories', count(DISTINCT category), 'category', 82 FROM sales
    UNION ALL SELECT 'Regions', count(DISTINCT region), 'region', 82 FROM sales"""))
def kpi4(spark, sf):
    return _plain(K.role_distinct(Tables(spark, sf).sales))


def _kpi_sql(name: str, value: str, source: str, confidence: int, view: str = "sales") -> str:
    return sql(view, f"SELECT '{name}' AS kpi, round({value}, 2) AS value, '{source}' AS source, {confidence}::BIGINT AS confidence FROM {view}")


@query("kpi5_margin", _kpi_sql("Margins", "(sum(revenue) - sum(cost)) / abs(sum(revenue)) * 100", "revenue,cost", 84))
def kpi5(spark, sf):
    return _plain(K.margin(Tables(spark, sf).sales))


@query("kpi6_avg_rate_rating", """
    SELECT 'Conversion Rate' AS kpi, round(avg(l_tax), 2) AS value, 'tax_rate' AS source, 82::BIGINT AS confidence FROM lineitem
    UNION ALL SELECT 'Average Rating', round(avg(l_quantity), 2), 'score', 84 FROM lineitem""")
def kpi6(spark, sf):
    li = Tables(spark, sf).lineitem
    return _plain(K.average_rates(li.select(F.col("l_tax").alias("tax_rate"), F.col("l_quantity").alias("score"))))


@query("kpi7_average_order_value", _kpi_sql("Average Order Value", "sum(revenue) / count(DISTINCT order_id)", "revenue,order_id", 88))
def kpi7(spark, sf):
    return _plain(K.average_order_value(Tables(spark, sf).sales))


@query("kpi8_revenue_per_customer", _kpi_sql("Revenue Per Customer", "sum(revenue) / count(DISTINCT customer_name)", "revenue,customer_name", 86))
def kpi8(spark, sf):
    return _plain(K.revenue_per_customer(Tables(spark, sf).sales))


@query("kpi9_revenue_per_product", _kpi_sql("Revenue Per Product", "sum(revenue) / count(DISTINCT product_name)", "revenue,product_name", 86))
def kpi9(spark, sf):
    return _plain(K.revenue_per_product(Tables(spark, sf).sales))


@query("kpi10_inventory_turnover", """
    SELECT 'Inventory Turnover' AS kpi, round(sum(l_quantity) / avg(p_size), 2) AS value, 'units_sold,stock' AS source, 76::BIGINT AS confidence
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def kpi10(spark, sf):
    t = Tables(spark, sf)
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return _plain(K.inventory_turnover(joined.select(F.col("l_quantity").alias("units_sold"), F.col("p_size").alias("stock"))))


_MONTHS = """
    , m AS (SELECT start, revenue AS v, lag(revenue) OVER (ORDER BY start) AS p,
                   avg(revenue) OVER (ORDER BY start ROWS 2 PRECEDING) AS a FROM monthly)
    , l AS (SELECT * FROM m ORDER BY start DESC LIMIT 1)"""


@query("kpi11_growth_rate", sql("monthly", _MONTHS + """
    SELECT 'Growth Rate' AS kpi, round((v - p) / abs(p) * 100, 2) AS value, 'revenue,order_date' AS source, 82::BIGINT AS confidence FROM l"""))
def kpi11(spark, sf):
    return _plain(K.growth_rate(Tables(spark, sf).sales, "revenue", "order_date"))


@query("kpi12_moving_forecast", sql("monthly", _MONTHS + """
    SELECT 'Forecast Revenue' AS kpi, round(a, 2) AS value, 'revenue,order_date' AS source, 70::BIGINT AS confidence FROM l"""))
def kpi12(spark, sf):
    return _plain(K.moving_forecast(Tables(spark, sf).sales, "revenue", "order_date"))


@query("kpi13_sales_velocity", _kpi_sql(
    "Sales Velocity", "sum(quantity) / greatest(date_diff('day', min(order_date), max(order_date)), 1)", "quantity,order_date", 78))
def kpi13(spark, sf):
    return _plain(K.sales_velocity(Tables(spark, sf).sales, "quantity", "order_date"))


@query("kpi15_combine_confidence", """
    SELECT event_id, round_even((least(1, CASE WHEN value > 1 THEN value / 100 ELSE greatest(value, 0) END)
                            + least(1, (event_id % 120) / CASE WHEN event_id % 120 > 1 THEN 100e0 ELSE 1e0 END)) / 2 * 100, 0)::BIGINT AS confidence
    FROM events""")
def kpi15(spark, sf):
    e = Tables(spark, sf).events
    scores = F.array(F.col("value"), (F.col("event_id") % 120).cast("double"), F.lit(None).cast("double"))
    return e.select("event_id", confidence_percent(scores).alias("confidence"))


# ---------------------------------------------------------------- trends

def _grain_sql(grain: str) -> str:
    label = {"week": "(start + INTERVAL 6 DAY)", "month": "(start + INTERVAL 1 MONTH - INTERVAL 1 DAY)",
             "quarter": "(start + INTERVAL 3 MONTH - INTERVAL 1 DAY)", "year": "(start + INTERVAL 1 YEAR - INTERVAL 1 DAY)", "day": "start"}[grain]
    return f"""
    SELECT '{grain}' AS grain, strftime({label}, '%Y-%m-%d') AS period, round(sum(revenue), 4) AS revenue, round(sum(quantity), 4) AS quantity
    FROM (SELECT date_trunc('{grain}', start) AS start, revenue, quantity FROM daily) GROUP BY start"""


@query("trd1_resample_sum", sql("daily", " UNION ALL ".join(_grain_sql(g) for g in ("day", "week", "month", "quarter", "year"))))
def trd1(spark, sf):
    sales = Tables(spark, sf).sales
    out = None
    for grain, name in (("D", "day"), ("W", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year")):
        part = TR.resample_sum(sales, "order_date", ["revenue", "quantity"], grain).select(
            F.lit(name).alias("grain"), F.date_format("period", "yyyy-MM-dd").alias("period"),
            F.round("revenue", 4).alias("revenue"), F.round("quantity", 4).alias("quantity"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_GROWTH = ", g AS (" + " UNION ALL ".join(f"""
    SELECT {i} AS o, '{label}' AS grain, '{m}' AS measure, date_trunc('{grain}', start) AS start, sum({m}) AS v FROM daily GROUP BY 4"""
    for i, (grain, label) in enumerate((("week", "WoW"), ("month", "MoM"), ("quarter", "QoQ"), ("year", "YoY")))
    for m in ("quantity", "revenue")) + """)
    , h AS (SELECT *, lag(v) OVER (PARTITION BY grain, measure ORDER BY start) AS p,
                   row_number() OVER (PARTITION BY grain, measure ORDER BY start DESC) AS k FROM g)
    , t AS (SELECT o, grain, measure, v, p, round((v - p) / abs(p) * 100, 2) AS growth,
                   CASE WHEN v > p THEN 'up' WHEN v < p THEN 'down' ELSE 'flat' END AS direction FROM h WHERE k = 1)"""


@query("trd2_period_growth", sql("daily", _GROWTH + """
    SELECT grain, measure, round(v, 4) AS current, round(p, 4) AS previous, growth AS growth_percent, direction FROM t"""))
def trd2(spark, sf):
    return TR.period_growth(Tables(spark, sf).sales, "order_date", ["quantity", "revenue"])


@query("trd2_monthly_growth_orders", """
    WITH m AS (SELECT date_trunc('month', o_orderdate) p, sum(o_totalprice) s FROM orders GROUP BY 1),
         cal AS (SELECT unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, INTERVAL 1 MONTH)) p FROM m),
         f AS (SELECT cal.p, coalesce(m.s, 0) s FROM cal LEFT JOIN m ON cal.p = m.p::TIMESTAMP)
    SELECT strftime(p + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS period, round(s, 2) AS value,
           round((s - lag(s) OVER (ORDER BY p)) / abs(lag(s) OVER (ORDER BY p)) * 100, 2) AS growth_percent,
           CASE WHEN row_number() OVER (ORDER BY p) >= 3 THEN round(avg(s) OVER (ORDER BY p ROWS 2 PRECEDING), 2) END AS moving_forecast
    FROM f""")
def trd2b(spark, sf):
    monthly = K.monthly_kpis(Tables(spark, sf).orders, "o_totalprice", "o_orderdate")
    return monthly.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("trd3_trend_cards", sql("daily", _GROWTH + """
    SELECT measure || ' ' || grain AS label, round(v, 2) AS value, round(p, 2) AS previous, coalesce(growth, 0) AS trend,
           direction AS trend_direction FROM t ORDER BY o, measure"""))
def trd3(spark, sf):
    return TR.trend_cards(Tables(spark, sf).sales, ["quantity", "revenue"], "order_date")


_LEADER = ", g AS (" + union_sql(["quantity", "revenue", "cost"], """
    SELECT '{c}' AS measure, region AS label, sum({c}) AS v FROM sales GROUP BY 2""") + """)
    , k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v DESC, label) AS rank FROM g)
    , t AS (SELECT a.measure, a.label AS leader, b.label AS runner_up, a.v AS x, b.v AS y
            FROM k a JOIN k b ON a.measure = b.measure AND a.rank = 1 AND b.rank = 2)"""


@query("trd3_cards_without_time", sql("sales", _LEADER + """
    SELECT measure || ' by region' AS label, round(x, 2) AS value, round(y, 2) AS previous,
           round((x - y) / abs(y) * 100, 2) AS trend, 'up' AS trend_direction FROM t"""))
def trd3b(spark, sf):
    return TR.trend_cards(Tables(spark, sf).sales, ["quantity", "revenue", "cost"], dimension="region")


@query("trd3_cards_range", sql("sales", union_sql(["quantity", "revenue"], """
    SELECT '{c} range' AS label, round(avg({c}), 2) AS value, NULL::DOUBLE AS previous,
           round(max({c}) - min({c}), 2) AS trend, 'flat' AS trend_direction FROM sales""")))
def trd3c(spark, sf):
    return TR.trend_cards(Tables(spark, sf).sales, ["quantity", "revenue"])


@query("trd4_leader_gap", sql("sales", _LEADER + """
    SELECT measure, leader, runner_up, round(x, 2) AS leader_value, round(y, 2) AS runner_up_value,
           round((x - y) / abs(y) * 100, 2) AS difference_percent FROM t"""))
def trd4(spark, sf):
    return TR.leader_gap(Tables(spark, sf).sales, "region", ["quantity", "revenue", "cost"])


@query("trd5_linear_trend", sql("sales", union_sql(NUMBERS, """
    SELECT '{c}' AS measure, count({c}) AS points, round(""" + "regr_slope({c}, floor(epoch_us(order_date) / 1000000) - 946684800) * 86400" + """, 6) AS slope_per_day,
           round(regr_r2({c}, floor(epoch_us(order_date) / 1000000) - 946684800), 4) AS r2,
           80 + floor(regr_r2({c}, floor(epoch_us(order_date) / 1000000) - 946684800) * 20)::BIGINT AS confidence, NULL::VARCHAR AS note FROM sales""")))
def trd5(spark, sf):
    return TR.linear_trend(Tables(spark, sf).sales, "order_date", NUMBERS).withColumn("slope_per_day", F.round("slope_per_day", 6))


@query("trd6_quarter_growth", sql("monthly", """
    , k AS (SELECT revenue, row_number() OVER (ORDER BY start DESC) AS i FROM monthly)
    , a AS (SELECT avg(revenue) FILTER (WHERE i <= 3) AS r, avg(revenue) FILTER (WHERE i BETWEEN 4 AND 6) AS p FROM k)
    SELECT round(r, 2) AS recent_mean, round(p, 2) AS previous_mean, round((r - p) / p * 100, 1) AS growth_percent FROM a"""))
def trd6(spark, sf):
    return TR.quarter_growth(Tables(spark, sf).sales, "order_date", "revenue")


@query("trd7_recent_week_change", sql("daily", """
    , k AS (SELECT revenue, row_number() OVER (ORDER BY start DESC) AS i FROM daily)
    , a AS (SELECT avg(revenue) FILTER (WHERE i <= 7) AS r, avg(revenue) FILTER (WHERE i BETWEEN 8 AND 14) AS p FROM k)
    , c AS (SELECT *, round((r - p) / abs(p) * 100, 1) AS change FROM a)
    SELECT round(r, 4) AS recent_mean, round(p, 4) AS previous_mean, change AS change_percent, abs(change) >= 20 AS flagged,
           CASE WHEN abs(change) >= 35 THEN 'High' WHEN abs(change) >= 20 THEN 'Medium' END AS impact FROM c"""))
def trd7(spark, sf):
    return TR.recent_week_change(Tables(spark, sf).sales, "order_date", "revenue")


@query("trd8_seasonality", sql("monthly", """
    , k AS (SELECT month(start) AS m, avg(revenue) AS v FROM monthly GROUP BY 1)
    SELECT arg_max(m, v)::INT AS peak_month, arg_min(m, v)::INT AS low_month, round(max(v), 2) AS peak_value, round(min(v), 2) AS low_value FROM k"""))
def trd8(spark, sf):
    return TR.seasonality(Tables(spark, sf).sales, "order_date", "revenue")


@query("trd9_cohorts", sql("sales", """
    , c AS (SELECT customer_name, strftime(min(order_date) OVER (PARTITION BY customer_name), '%Y-%m') AS m FROM sales)
    SELECT m AS cohort_month, count(*) AS rows, count(DISTINCT customer_name) AS customers FROM c GROUP BY 1 ORDER BY 2 DESC, 1"""))
def trd9(spark, sf):
    return TR.cohorts(Tables(spark, sf).sales, "customer_name", "order_date")


def _spike_sql(partition: str) -> str:
    return f"""
    WITH e AS (SELECT value, lag(value) OVER ({partition} ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL)
    SELECT 'value' AS measure, count(*) FILTER (WHERE p <> 0 AND value / p - 1 >= 1) AS spikes,
           count(*) FILTER (WHERE p <> 0 AND value / p - 1 <= -0.5) AS drops FROM e"""


@query("trd10_pct_change_spikes", _spike_sql("PARTITION BY user_id"))
def trd10(spark, sf):
    return TR.pct_change_spikes(Tables(spark, sf).events, ["value"], ["ts", "event_id"], F.to_date("ts"), ["user_id"])


@query("trd10_spikes_whole_table", _spike_sql(""))
def trd10b(spark, sf):
    return TR.pct_change_spikes(Tables(spark, sf).events, ["value"], ["ts", "event_id"], F.to_date("ts"))


_HALF = """
    , mid AS (SELECT median(epoch_us(order_date)) AS t FROM sales)
    , h AS (SELECT *, epoch_us(order_date) > t AS late FROM sales, mid)"""


@query("trd11_half_period_change", sql("sales", _HALF + """
    , a AS (SELECT sum(revenue) FILTER (WHERE NOT late) AS p, sum(revenue) FILTER (WHERE late) AS r FROM h)
    SELECT round(p, 2) AS previous, round(r, 2) AS recent, round((r - p) / abs(p) * 100, 1) AS change_percent,
           CASE WHEN round((r - p) / abs(p) * 100, 1) < 0 THEN 'dropped' ELSE 'increased' END AS direction FROM a"""))
def trd11(spark, sf):
    return TR.half_period_change(Tables(spark, sf).sales, "order_date", "revenue")


_DELTAS = _HALF + """
    , d AS (SELECT product_name AS label, coalesce(sum(revenue) FILTER (WHERE late), 0) AS a,
                   coalesce(sum(revenue) FILTER (WHERE NOT late), 0) AS b FROM h GROUP BY 1)"""


@query("trd12_change_driver", sql("sales", _DELTAS + """
    , s AS (SELECT sum(a - b) AS total FROM d)
    SELECT round(total, 2) AS total_change,
           CASE WHEN total < 0 THEN (SELECT label FROM d ORDER BY a - b, label LIMIT 1) ELSE (SELECT label FROM d ORDER BY a - b DESC, label LIMIT 1) END AS driver,
           CASE WHEN total < 0 THEN (SELECT round(min(a - b), 2) FROM d) ELSE (SELECT round(max(a - b), 2) FROM d) END AS driver_change FROM s"""))
def trd12(spark, sf):
    return TR.change_driver(Tables(spark, sf).sales, "order_date", "revenue", "product_name")


@query("trd13_date_parts", """
    SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
           (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek FROM orders""")
def trd13(spark, sf):
    return TR.date_parts(Tables(spark, sf).orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate")


# ---------------------------------------------------------------- grouped analysis

_BY_PRODUCT = ", g AS (SELECT product_name AS label, sum(revenue) AS v FROM sales GROUP BY 1)"


@query("agg1_group_sum_rank", sql("sales", _BY_PRODUCT + """
    SELECT label, round(v, 2) AS amount, round(v / (SELECT sum(revenue) FROM sales) * 100, 2) AS share FROM g"""))
def agg1(spark, sf):
    return G.group_sum_rank(Tables(spark, sf).sales, "product_name", "revenue")


@query("agg2_top_n", sql("sales", _BY_PRODUCT + """
    , t AS (SELECT * FROM g ORDER BY v DESC, label LIMIT 10)
    SELECT row_number() OVER (ORDER BY v DESC, label)::INT AS rank, label, round(v, 2) AS amount,
           round(v / sum(v) OVER () * 100, 1) AS share FROM t"""))
def agg2(spark, sf):
    return G.top_n(Tables(spark, sf).sales, "product_name", "revenue", 10)


@query("agg3_bottom_group", sql("sales", _BY_PRODUCT + """
    SELECT label, round(v, 2) AS amount, round(v / (SELECT sum(revenue) FROM sales) * 100, 1) AS share FROM g ORDER BY v, label LIMIT 1"""))
def agg3(spark, sf):
    return G.bottom_group(Tables(spark, sf).sales, "product_name", "revenue")


@query("agg3_bottom_group_by_count", sql("sales", """
    SELECT product_name AS label, count(*)::DOUBLE AS amount, round(count(*) * 100e0 / (SELECT count(*) FROM sales), 1) AS share
    FROM sales GROUP BY 1 ORDER BY count(*), 1 LIMIT 1"""))
def agg3b(spark, sf):
    return G.bottom_group(Tables(spark, sf).sales, "product_name")


@query("agg4_concentration", sql("sales", freq_sql("sales", TEXTS) + """
    SELECT "column", max(v) FILTER (WHERE k = 1) AS top_value, round(max(n * 100e0 / t) FILTER (WHERE k = 1), 2) AS top_share,
           round(sum(n) FILTER (WHERE k <= 3) * 100e0 / max(t), 2) AS top_3_share FROM r GROUP BY 1"""))
def agg4(spark, sf):
    return G.concentration(Tables(spark, sf).sales)


@query("agg5_pareto", sql("sales", _BY_PRODUCT + """
    , t AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rank, sum(v) OVER (ORDER BY v DESC, label) AS run FROM g)
    SELECT rank::INT AS rank, label, round(v, 2) AS amount, round(v / (SELECT sum(v) FROM g) * 100, 2) AS share,
           round(run / (SELECT sum(v) FROM g) * 100, 2) AS cumulative_share FROM t WHERE rank <= 3"""))
def agg5(spark, sf):
    return G.pareto(Tables(spark, sf).sales, "product_name", "revenue")


@query("agg6_value_counts", sql("sales", freq_sql("sales", TEXTS) + """
    SELECT "column", k::INT AS rank, v AS value, n AS records, round(n * 100e0 / t, 2) AS share FROM r WHERE k <= 6"""))
def agg6(spark, sf):
    return G.value_counts(Tables(spark, sf).sales, TEXTS, 6)


_CORR = ", c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM holed" for a, b in combinations(("quantity", "revenue", "discount"), 2)) + ")"


@query("agg7_correlation_matrix", sql("holed", _CORR + """
    SELECT col_a, col_b, round(r, 4) AS corr FROM c UNION ALL SELECT col_b, col_a, round(r, 4) FROM c
    UNION ALL SELECT unnest(['quantity', 'revenue', 'discount']), unnest(['quantity', 'revenue', 'discount']), 1e0"""))
def agg7(spark, sf):
    return G.correlation_matrix(Tables(spark, sf).holed, ["quantity", "revenue", "discount"])


@query("agg8_top_correlations", sql("sales", ", c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM sales" for a, b in combinations(NUMBERS, 2)) + """)
    , t AS (SELECT * FROM c ORDER BY abs(r) DESC LIMIT 10)
    SELECT col_a, col_b, round(r, 4) AS corr FROM t WHERE abs(r) >= 0.35"""))
def agg8(spark, sf):
    return G.top_correlations(Tables(spark, sf).sales, NUMBERS, threshold=0.35)


@query("agg9_numeric_leaderboard", sql("sales", ", t AS (" + union_sql(NUMBERS, """
    SELECT '{c}' AS "column", sum({c}) AS v FROM sales""") + """)
    SELECT "column", round(v, 2) AS total, round(v / (SELECT sum(v) FROM t) * 100, 1) AS share FROM t"""))
def agg9(spark, sf):
    return G.numeric_leaderboard(Tables(spark, sf).sales)


@query("agg10_segment_revenue_share", sql("sales", ", f AS (" + union_sql(["region", "category"], """
    SELECT '{c}' AS "column", {c} AS v, count(*) AS n, sum(revenue) AS a FROM sales GROUP BY 2""") + """)
    , r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY "column") AS t,
                   sum(a) OVER (PARTITION BY "column") AS s FROM f)
    SELECT "column", v AS top_value, round(n * 100e0 / t, 1) AS top_share, round(a / s * 100, 1) AS revenue_share FROM r WHERE k = 1 AND n * 100e0 / t >= 15"""))
def agg10(spark, sf):
    return G.segment_revenue_share(Tables(spark, sf).sales, ["region", "category"], "revenue", threshold=15.0)


@query("agg11_mean_vs_median", sql("sales", "SELECT 'revenue' AS \"column\", round(avg(revenue), 2) AS mean, round(median(revenue), 2) AS median FROM sales"))
def agg11(spark, sf):
    return G.mean_vs_median(Tables(spark, sf).sales, "revenue")


# ---------------------------------------------------------------- anomalies by rule

# The square of the event value has a long tail.
_TAIL = "WITH t AS (SELECT event_id, ts, value, value * value AS square FROM events)"


def tail_events(spark, sf):
    e = Tables(spark, sf).events
    return e.select("event_id", "ts", "value", (F.col("value") * F.col("value")).alias("square"))


@query("anm1_zscore", _TAIL + """
    , s AS (SELECT avg(value) AS vm, stddev_samp(value) AS vs, avg(square) AS sm, stddev_samp(square) AS ss FROM t)
    SELECT 'value' AS "column", count(*) FILTER (WHERE (value - vm) / vs >= 3) AS high, count(*) FILTER (WHERE (value - vm) / vs <= -3) AS low,
           count(*) FILTER (WHERE abs(value - vm) / vs >= 3) AS anomalies FROM t, s
    UNION ALL SELECT 'square', count(*) FILTER (WHERE (square - sm) / ss >= 3), count(*) FILTER (WHERE (square - sm) / ss <= -3),
           count(*) FILTER (WHERE abs(square - sm) / ss >= 3) FROM t, s""")
def anm1(spark, sf):
    return A.zscore(tail_events(spark, sf), ["value", "square"])


_EVENT_BOUNDS = """
    , w AS (SELECT quantile_cont(value, 0.25) - 1.5e0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS value_lo,
                   quantile_cont(value, 0.75) + 1.5e0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS value_hi,
                   quantile_cont(square, 0.25) - 1.5e0 * (quantile_cont(square, 0.75) - quantile_cont(square, 0.25)) AS square_lo,
                   quantile_cont(square, 0.75) + 1.5e0 * (quantile_cont(square, 0.75) - quantile_cont(square, 0.25)) AS square_hi FROM t)"""


@query("anm2_iqr", _TAIL + _EVENT_BOUNDS + union_sql(["value", "square"], """
    SELECT '{c}' AS "column", round(any_value({c}_lo), 4) AS lower_bound, round(any_value({c}_hi), 4) AS upper_bound,
           count(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi) AS outliers,
           round(count(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi) * 100e0 / count(*), 1) AS percent FROM t, w"""))
def anm2(spark, sf):
    return A.iqr_anomalies(tail_events(spark, sf), ["value", "square"])


@query("anm3_rule_anomalies", _TAIL + _EVENT_BOUNDS + """
    , s AS (SELECT avg(value) AS value_m, stddev_samp(value) AS value_s, avg(square) AS square_m, stddev_samp(square) AS square_s FROM t)
    , l AS (SELECT *, lag(value) OVER o AS value_p, lag(square) OVER o AS square_p FROM t, w, s WINDOW o AS (ORDER BY ts, event_id))
    , f AS (""" + union_sql(["value", "square"], """
    SELECT '{c}' AS "column", {c} < {c}_lo OR {c} > {c}_hi AS iqr, coalesce({c} / nullif({c}_p, 0) - 1 <= -0.5, false) AS fall,
           coalesce({c} / nullif({c}_p, 0) - 1 >= 1, false) AS rise, abs({c} - {c}_m) / {c}_s >= 3 AS z FROM l""") + """)
    , k AS (SELECT "column", concat_ws(', ', CASE WHEN bool_or(iqr) THEN 'iqr' END, CASE WHEN bool_or(fall) THEN 'sudden_drop' END,
                   CASE WHEN bool_or(rise) THEN 'sudden_spike' END, CASE WHEN bool_or(z) THEN 'z_score' END) AS type,
                   count(*) FILTER (WHERE iqr OR fall OR rise OR z) AS n, count(*) AS rows FROM f GROUP BY 1)
    SELECT "column", type, n AS anomaly_count, round(n * 100e0 / rows, 4) AS anomaly_percent,
           CASE WHEN n * 100e0 / rows >= 5 OR n >= 25 THEN 'high' ELSE 'medium' END AS severity, 82::BIGINT AS confidence_score FROM k""")
def anm3(spark, sf):
    found = A.rule_anomalies(tail_events(spark, sf), ["ts", "event_id"], F.to_date("ts"), ["value", "square"])
    return found.withColumn("anomaly_percent", F.round("anomaly_percent", 4))


_USER = ["events", "total", "mean", "top"]


@query("anm4_row_zscore", sql("user_features", """
    , s AS (SELECT """ + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in _USER) + """ FROM user_features)
    , z AS (SELECT """ + ", ".join(f"abs({c} - {c}_m) / {c}_s AS {c}" for c in _USER) + """ FROM user_features, s)
    , h AS (SELECT * FROM z WHERE greatest(events, total, mean, top) >= 2)
    , u AS (""" + union_sql(_USER, "SELECT '{c}' AS \"column\", avg({c}) AS v FROM h") + """)
    SELECT row_number() OVER (ORDER BY v DESC, "column" DESC)::INT AS rank, "column", round(v, 4) AS mean_abs_z,
           (SELECT count(*) FROM h) AS anomaly_count, round((SELECT count(*) FROM h) * 100e0 / (SELECT count(*) FROM z), 2) AS anomaly_percent FROM u"""))
def anm4(spark, sf):
    return A.row_zscore(Tables(spark, sf).user_features, _USER, threshold=2.0)


@query("anm10_kpi_move_flags", sql("daily", _GROWTH + """
    SELECT grain, measure, growth AS growth_percent, CASE WHEN growth > 0 THEN 'positive' ELSE 'negative' END AS severity
    FROM t WHERE abs(growth) >= 35"""))
def anm10(spark, sf):
    found = A.kpi_move_flags(TR.period_growth(Tables(spark, sf).sales, "order_date", ["quantity", "revenue"]))
    return found.select("grain", "measure", "growth_percent", "severity")


# ---------------------------------------------------------------- chart series

def _bin_sql(c: str, bins: int) -> str:
    return f"least(floor(({c} - {c}_lo) / ({c}_hi - {c}_lo) * {bins}), {bins - 1})::BIGINT"


_RANGE = ", w AS (SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in ("quantity", "revenue")) + " FROM sales)"


@query("cht1_histogram", sql("sales", _RANGE + " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {_bin_sql(c, 28)} AS bin, round(any_value({c}_lo) + {_bin_sql(c, 28)} * ((any_value({c}_hi) - any_value({c}_lo)) / 28), 4) AS low,
           round(any_value({c}_lo) + ({_bin_sql(c, 28)} + 1) * ((any_value({c}_hi) - any_value({c}_lo)) / 28), 4) AS high, count(*) AS records
    FROM sales, w GROUP BY 2""" for c in ("quantity", "revenue"))))
def cht1(spark, sf):
    return CH.histogram(Tables(spark, sf).sales, ["quantity", "revenue"])


@query("cht2_box", _TAIL + _EVENT_BOUNDS + union_sql(["value", "square"], """
    SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3,
           round(min({c}) FILTER (WHERE {c} >= {c}_lo), 4) AS whisker_low, round(max({c}) FILTER (WHERE {c} <= {c}_hi), 4) AS whisker_high,
           count(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi) AS outliers FROM t, w"""))
def cht2(spark, sf):
    return CH.box(tail_events(spark, sf), ["value", "square"])


@query("cht2_outlier_points", _TAIL + _EVENT_BOUNDS + " SELECT event_id, round(square, 6) AS square FROM t, w WHERE square < square_lo OR square > square_hi")
def cht2b(spark, sf):
    return CH.outlier_points(tail_events(spark, sf), "square").select("event_id", F.round("square", 6).alias("square"))


@query("cht3_scatter_density", sql("sales", _RANGE + f"""
    SELECT {_bin_sql('quantity', 20)} AS x_bin, {_bin_sql('revenue', 20)} AS y_bin, count(*) AS records FROM sales, w GROUP BY 1, 2"""))
def cht3(spark, sf):
    return CH.scatter_density(Tables(spark, sf).sales, "quantity", "revenue")


@query("cht4_bar", sql("sales", freq_sql("sales", TEXTS) + """
    SELECT "column", k::INT AS rank, v AS value, n AS records FROM r WHERE k <= 10"""))
def cht4(spark, sf):
    return CH.bar(Tables(spark, sf).sales, TEXTS)


@query("cht4_pie", sql("sales", freq_sql("sales", TEXTS) + """
    SELECT "column", k::INT AS rank, v AS value, n AS records, round(n * 100e0 / sum(n) OVER (PARTITION BY "column"), 2) AS share
    FROM r WHERE k <= 10"""))
def cht4b(spark, sf):
    return CH.pie(Tables(spark, sf).sales, TEXTS)


@query("cht5_line", sql("monthly", union_sql(["quantity", "revenue"], """
    SELECT strftime(start + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS period, '{c}' AS measure, round({c}, 4) AS value FROM monthly""")))
def cht5(spark, sf):
    found = CH.line(Tables(spark, sf).sales, "order_date", ["quantity", "revenue"], "M")
    return found.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "measure", F.round("value", 4).alias("value"))


@query("cht5_line_by_row", """
    WITH w AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)
    SELECT least(floor((event_id - lo) / (hi - lo)::DOUBLE * 500), 499)::BIGINT AS slot, count(*) AS rows, round(avg(value), 4) AS mean_value
    FROM events, w GROUP BY 1""")
def cht5b(spark, sf):
    return CH.line_by_row(Tables(spark, sf).events, "value", "event_id")


@query("cht6_heatmap", sql("sales", ", c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS corr FROM sales" for a, b in combinations(NUMBERS, 2)) + """)
    SELECT * FROM c UNION ALL SELECT col_b, col_a, corr FROM c UNION ALL
    SELECT unnest(['quantity', 'revenue', 'discount', 'cost']), unnest(['quantity', 'revenue', 'discount', 'cost']), 1e0"""))
def cht6(spark, sf):
    return CH.heatmap(Tables(spark, sf).sales, NUMBERS)
