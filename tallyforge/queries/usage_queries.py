"""Questions, text and language, bookkeeping, metering and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions import lookups as L
from tallyforge.operators import language as LG, relational as RL, usage as U
from tallyforge.plans import ask as ASK
from tallyforge.queries.base import VIEWS, Tables, query, scratch_folder, sql
from tallyforge.streaming import jobs as ST

# Questions put into the turns of ``conversations``: (text, intent, dimension, measure, n).
PHRASES = [
    ("Top 5 product by revenue", "top_n", "product_name", "revenue", 5),
    ("Hamare products kitne hain", "unique_count", "product_name", None, 1),
    ("Why did revenue change?", "why_change", "product_name", "revenue", 1),
    ("Which region is the weakest by quantity", "weakest", "region", "quantity", 1),
    ("What is the average discount", "average", None, "discount", 1),
    ("Most frequent category please", "most_common", "category", None, 1),
    ("Any outlier in revenue", "outliers", None, "revenue", 1),
    ("List the fields", "columns", None, None, 1),
    ("Is there a duplicate", "quality", None, None, 1),
    ("Recommend a next step for category", "advice", "category", "revenue", 1),
    ("सबसे ज्यादा बिक्री ग्राहक", "leader", "customer_name", "revenue", 1),
    ("Show the delivery status", "unknown", None, None, 1),
    ("best category", "top_count", "category", None, 1),
    ("How many rows", "rows", None, None, 1),
]
_PICK = f"[1 + (conv_id + turn) % {len(PHRASES)}]"


def _list(values) -> str:
    quoted = ("'" + v + "'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in values)
    return "[" + ", ".join(quoted) + "]"


# Every turn of every role asks: its whole text with a phrase behind it, chosen by conversation and turn number.
VIEWS["phrases"] = ([], f"SELECT conv_id, turn, text, {_list(p[0] for p in PHRASES)}{_PICK} AS phrase FROM conversations")
VIEWS["questions"] = (["phrases"], "SELECT conv_id, turn, coalesce(text, '') || ' ' || phrase AS question FROM phrases")


def phrases(t: Tables) -> DataFrame:
    """One phrase per turn, beside the turn's text."""
    words = F.array(*[F.lit(p[0]) for p in PHRASES])
    at = ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int")
    return t.conversations.select("conv_id", "turn", "text", words[at].alias("phrase"))


def questions(t: Tables) -> DataFrame:
    """The whole text of every turn, whatever its role, and a phrase that asks something."""
    return phrases(t).select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), "phrase").alias("question"))


def _replaced(expr: str, terms) -> str:
    return reduce(lambda e, t: f"replace({e}, '{t[0]}', '{t[1]}')", terms, expr)


@query("qa1_normalize_question", sql("questions", f"SELECT conv_id, turn, {_replaced('trim(lower(question))', L.QUESTION_TERMS)} AS normalized FROM questions"))
def qa1(spark, sf):
    return questions(Tables(spark, sf)).select("conv_id", "turn", LG.normalize_question(F.col("question")).alias("normalized"))


@query("qa1_normalize_spoken", sql("questions", f"""
    SELECT conv_id, turn, trim(regexp_replace({_replaced("' ' || trim(lower(question)) || ' '", L.ASSISTANT_TERMS)}, '\\s+', ' ', 'g')) AS normalized FROM questions"""))
def qa1b(spark, sf):
    return questions(Tables(spark, sf)).select("conv_id", "turn", LG.normalize_spoken(F.col("question")).alias("normalized"))


def _has(*words: str) -> str:
    return "(" + " OR ".join("contains(q, '{}')".format(w.replace("'", "''")) for w in words) + ")"


def _role(name: str) -> str:
    return _has(name, *L.QUESTION_ROLES[name])


# The rules for the header of the sales view. Profit is asked of revenue, since the view has no column of that kind.
_METRIC = (f"CASE WHEN {_role('profit')} THEN 'revenue' WHEN {_role('revenue')} THEN 'revenue' WHEN {_role('quantity')} THEN 'quantity' "
           f"WHEN {_role('discount')} THEN 'discount' END")
_NAMED = """CASE WHEN contains(u, 'customer name') THEN 'customer_name' WHEN contains(u, 'product name') THEN 'product_name' WHEN contains(u, 'category') THEN 'category'
    WHEN contains(u, 'region') THEN 'region' WHEN contains(u, 'customer') OR contains(u, 'name') THEN 'customer_name' WHEN contains(u, 'product') THEN 'product_name' END"""
_NUMBER = """CASE WHEN contains(u, 'order id') THEN 'order_id' WHEN contains(u, 'quantity') THEN 'quantity' WHEN contains(u, 'revenue') THEN 'revenue'
    WHEN contains(u, 'discount') THEN 'discount' WHEN contains(u, 'cost') THEN 'cost' WHEN contains(u, 'order') THEN 'order_id' END"""
VIEWS["asked"] = (["questions"], f"SELECT conv_id, turn, {_replaced('trim(lower(question))', L.QUESTION_TERMS)} AS q, replace({_replaced('trim(lower(question))', L.QUESTION_TERMS)}, '_', ' ') AS u FROM questions")
VIEWS["resolved"] = (["asked"], f"""
    SELECT *, {_METRIC} AS metric, {_NAMED} AS named, {_NUMBER} AS number, {_role('status')} AS unknown_field,
           coalesce(CASE WHEN {_role('product')} THEN 'product_name' WHEN {_role('city')} THEN 'region' WHEN {_role('customer')} THEN 'customer_name'
                         WHEN {_role('category')} THEN 'category' END, {_NAMED}, 'product_name') AS dimension,
           coalesce({_METRIC}, {_NUMBER}, 'revenue') AS measure FROM asked""")
VIEWS["intents"] = (["resolved"], f"""
    SELECT *, CASE WHEN unknown_field THEN 'unknown'
        WHEN {_has(*L.COUNT_WORDS)} AND {_role('product')} THEN 'count product' WHEN {_has(*L.COUNT_WORDS)} AND {_role('customer')} THEN 'count customer'
        WHEN {_has(*L.COUNT_WORDS)} AND contains(q, 'order') THEN 'count order'
        WHEN contains(q, 'why') AND ({_role('profit')} OR {_role('revenue')}) THEN 'why_change'
        WHEN {_has(*L.WEAK_WORDS)} OR (contains(q, 'least') AND contains(q, 'perform')) THEN 'weakest'
        WHEN top AND segment AND n > 1 THEN 'top_n' WHEN top AND segment AND number IS NULL AND metric IS NULL THEN 'top_count'
        WHEN top AND segment THEN 'leader' WHEN top THEN 'highest_value' WHEN {_has(*L.AVERAGE_WORDS)} THEN 'average' WHEN {_has(*L.COMMON_WORDS)} THEN 'most_common'
        WHEN {_has(*L.OUTLIER_WORDS)} THEN 'outliers' WHEN {_has(*L.ROW_WORDS)} THEN 'rows' WHEN {_has(*L.COLUMN_WORDS)} THEN 'columns'
        WHEN {_has(*L.QUALITY_WORDS)} THEN 'quality' WHEN {_has(*L.ADVICE_WORDS)} THEN 'advice' ELSE 'unknown' END AS rule
    FROM (SELECT *, {_has(*L.TOP_WORDS)} AS top, greatest(1, least(25, coalesce(try_cast(regexp_extract(q, 'top\\s+(\\d+)', 1) AS INTEGER), 1))) AS n,
                 named IS NOT NULL OR {' OR '.join(_role(r) for r in ('category', 'product', 'city', 'customer', 'date'))} AS segment FROM resolved)""")


@query("qa2_resolve_columns", sql("resolved", "SELECT conv_id, turn, dimension, measure FROM resolved"))
def qa2(spark, sf):
    t = Tables(spark, sf)
    return ASK.resolve_columns(t.sales, questions(t)).select("conv_id", "turn", "dimension", "measure")


@query("qa3_unknown_field", sql("resolved", "SELECT conv_id, turn FROM resolved WHERE unknown_field"))
def qa3(spark, sf):
    t = Tables(spark, sf)
    return ASK.resolve_columns(t.sales, questions(t)).where("unknown_field").select("conv_id", "turn")


VIEWS["plans"] = (["intents"], """
    SELECT conv_id, turn, CASE WHEN rule LIKE 'count %' THEN 'unique_count' ELSE rule END AS intent,
           CASE rule WHEN 'count product' THEN 'product_name' WHEN 'count customer' THEN 'customer_name' WHEN 'count order' THEN 'order_id'
                WHEN 'top_n' THEN coalesce(named, dimension) WHEN 'top_count' THEN coalesce(named, dimension) WHEN 'leader' THEN coalesce(named, dimension)
                WHEN 'why_change' THEN dimension WHEN 'weakest' THEN dimension WHEN 'most_common' THEN dimension WHEN 'advice' THEN dimension END AS dimension,
           CASE WHEN rule IN ('why_change', 'weakest', 'top_n', 'leader', 'highest_value', 'average', 'outliers', 'advice') THEN measure END AS measure,
           CASE WHEN rule IN ('top_n', 'top_count') THEN n ELSE 1 END::INT AS n FROM intents""")


@query("qa_plan_questions", sql("plans", "SELECT conv_id, turn, intent, dimension, measure, n FROM plans"))
def qa_plan(spark, sf):
    t = Tables(spark, sf)
    return ASK.plan_questions(t.sales, questions(t)).drop("question")


def _ask(text: str):
    return lambda spark, sf: ASK.ask(Tables(spark, sf).sales, text).select("answer_type", "label", "value", "share")


_BODIES: dict[str, str] = {
    "columns": "SELECT 'columns' AS answer_type, NULL::VARCHAR AS label, 10e0 AS value, NULL::DOUBLE AS share",
    "unknown": "SELECT 'unknown' AS answer_type, NULL::VARCHAR AS label, NULL::DOUBLE AS value, NULL::DOUBLE AS share",
}


def _asked(name: str, text: str, body: str) -> None:
    query(name, sql("sales", body))(_ask(text))
    body = body.strip()
    if text.lower() in {p[0].lower() for p in PHRASES} or name == "qa4_unique_count":
        intent = "unique_count" if name == "qa4_unique_count" else next(p[1] for p in PHRASES if p[0].lower() == text.lower())
        _BODIES[intent] = "WITH " + body[1:] if body.startswith(",") else body


_asked("qa4_unique_count", "How many products do we have?",
       "SELECT 'unique_count' AS answer_type, 'product_name' AS label, count(DISTINCT product_name)::DOUBLE AS value, NULL::DOUBLE AS share FROM sales")
_asked("qa4_unique_customers", "kitne grahak hain",
       "SELECT 'unique_count' AS answer_type, 'customer_name' AS label, count(DISTINCT customer_name)::DOUBLE AS value, NULL::DOUBLE AS share FROM sales")
_asked("qa4_unique_orders", "number of orders",
       "SELECT 'unique_count' AS answer_type, 'order_id' AS label, count(DISTINCT order_id)::DOUBLE AS value, NULL::DOUBLE AS share FROM sales")
_asked("qa5_why_change", "Why did revenue change?", """
    , mid AS (SELECT median(epoch_us(order_date)) AS t FROM sales), h AS (SELECT *, epoch_us(order_date) > t AS late FROM sales, mid)
    , d AS (SELECT product_name AS l, coalesce(sum(revenue) FILTER (WHERE late), 0) - coalesce(sum(revenue) FILTER (WHERE NOT late), 0) AS x FROM h GROUP BY 1)
    , a AS (SELECT sum(revenue) FILTER (WHERE NOT late) AS p, sum(revenue) FILTER (WHERE late) AS r FROM h)
    SELECT 'why_change' AS answer_type, CASE WHEN r < p THEN (SELECT l FROM d ORDER BY x, l LIMIT 1) ELSE (SELECT l FROM d ORDER BY x DESC, l LIMIT 1) END AS label,
           round((r - p) / abs(p) * 100, 1) AS value, NULL::DOUBLE AS share FROM a""")
_asked("qa6_weakest", "Which region is the weakest by quantity", """
    SELECT 'weakest' AS answer_type, region AS label, round(sum(quantity), 2) AS value, round(sum(quantity) / (SELECT sum(quantity) FROM sales) * 100, 1) AS share
    FROM sales GROUP BY region ORDER BY sum(quantity), region LIMIT 1""")
_asked("qa7_top_n", "top 5 product by revenue", """
    , t AS (SELECT product_name, sum(revenue) AS v FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT 'top_n' AS answer_type, product_name AS label, round(v, 2) AS value, round(v / sum(v) OVER () * 100, 1) AS share FROM t""")
_asked("qa7_top_count", "best category", """
    SELECT 'top_count' AS answer_type, category AS label, count(*)::DOUBLE AS value, round(count(*) * 100e0 / (SELECT count(*) FROM sales), 1) AS share
    FROM sales GROUP BY category ORDER BY count(*) DESC, category LIMIT 1""")
_asked("qa7_leader", "सबसे ज्यादा बिक्री ग्राहक", """
    SELECT 'leader' AS answer_type, customer_name AS label, round(sum(revenue), 2) AS value, round(round(sum(revenue) / (SELECT sum(revenue) FROM sales) * 100, 2), 1) AS share
    FROM sales GROUP BY customer_name ORDER BY sum(revenue) DESC, customer_name LIMIT 1""")
_asked("qa7_highest_value", "maximum discount",
       "SELECT 'highest_value' AS answer_type, 'discount' AS label, max(discount) AS value, NULL::DOUBLE AS share FROM sales")
_asked("qa8_average", "What is the average discount",
       "SELECT 'average' AS answer_type, 'discount' AS label, round(avg(discount), 2) AS value, round(median(discount), 2) AS share FROM sales")
_asked("qa9_most_common", "Most frequent category please", """
    SELECT 'most_common' AS answer_type, category AS label, count(*)::DOUBLE AS value, round(count(*) * 100e0 / (SELECT count(*) FROM sales), 1) AS share
    FROM sales GROUP BY category ORDER BY count(*) DESC, category LIMIT 1""")
_asked("qa10_outliers", "Any outlier in revenue", """
    , w AS (SELECT quantile_cont(revenue, 0.25) AS a, quantile_cont(revenue, 0.75) AS b FROM sales)
    , o AS (SELECT count(*) FILTER (WHERE revenue < a - 1.5e0 * (b - a) OR revenue > b + 1.5e0 * (b - a)) AS n, count(*) AS rows FROM sales, w)
    SELECT 'outliers' AS answer_type, 'revenue' AS label, n::DOUBLE AS value, round(n * 100e0 / rows, 1) AS share FROM o""")
_asked("qa11_rows", "How many rows", "SELECT 'rows' AS answer_type, NULL::VARCHAR AS label, count(*)::DOUBLE AS value, NULL::DOUBLE AS share FROM sales")
_asked("qa12_quality", "Is there a duplicate", """
    , g AS (SELECT count(*) AS n FROM sales GROUP BY order_id, order_date, customer_name, product_name, category, region, quantity, revenue, discount, cost)
    SELECT 'quality' AS answer_type, CASE WHEN sum(n - 1) = 0 THEN 'healthy' ELSE 'needs attention' END AS label, 0e0 AS value,
           round(sum(n - 1) * 100e0 / sum(n), 1) AS share FROM g""")
_asked("qa13_advice", "Recommend a next step for category", """
    SELECT 'advice' AS answer_type, category AS label, round(sum(revenue), 2) AS value, round(round(sum(revenue) / (SELECT sum(revenue) FROM sales) * 100, 2), 1) AS share
    FROM sales GROUP BY category ORDER BY sum(revenue) DESC, category LIMIT 1""")


@query("qa14_describe_column", sql("sales", """
    , t AS (SELECT category, count(*) AS n FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
    SELECT 'category has ' || (SELECT count(DISTINCT category) FROM sales) || ' unique values, top examples are '
           || (SELECT string_agg('''' || category || '''', ', ' ORDER BY n DESC, category) FROM t) || '.' AS text
    UNION ALL SELECT format('quantity has {} values, mean {:.2f}, min {:.2f}, max {:.2f}.', count(quantity), avg(quantity), min(quantity), max(quantity)) FROM sales"""))
def qa14(spark, sf):
    s = Tables(spark, sf).sales
    return ASK.describe_column(s, "category").unionByName(ASK.describe_column(s, "quantity")).select("text")


_SEGMENTS, _MEASURES = ["customer_name", "product_name", "category", "region"], ["order_id", "quantity", "revenue", "discount", "cost"]
_CELLS = " UNION ALL ".join(
    f"SELECT '{d}' AS d, {d}::VARCHAR AS label, {m} AS m, {amount}::DOUBLE AS amount FROM sales GROUP BY {d}"
    for d in [*_SEGMENTS, "order_id"] for m, amount in [("NULL::VARCHAR", "count(*)"), *((f"'{x}'", f"sum({x})") for x in _MEASURES)])
_NUMBERS = " UNION ALL ".join(
    f"""SELECT '{m}' AS m, max({m})::DOUBLE AS top, avg({m})::DOUBLE AS mean, median({m})::DOUBLE AS mid,
        (SELECT count(*) FROM sales, (SELECT quantile_cont({m}::DOUBLE, 0.25) AS a, quantile_cont({m}::DOUBLE, 0.75) AS b FROM sales)
         WHERE a < b AND ({m} < a - 1.5e0 * (b - a) OR {m} > b + 1.5e0 * (b - a))) AS far FROM sales""" for m in _MEASURES)
_SIDES = " UNION ALL ".join(
    f"""SELECT '{m}' AS m, {f"'{d}'" if d else "NULL::VARCHAR"} AS d, {d or "NULL::VARCHAR"} AS label, coalesce(sum({m}) FILTER (WHERE NOT late), 0)::DOUBLE AS p,
        coalesce(sum({m}) FILTER (WHERE late), 0)::DOUBLE AS r FROM h{f" GROUP BY {d}" if d else ""}""" for d in ["", *_SEGMENTS] for m in _MEASURES)


@query("qa_ask_many", sql("plans sales", f"""
    , cells AS ({_CELLS}), numbers AS ({_NUMBERS}), n AS (SELECT count(*) AS lines FROM sales)
    , totals AS (SELECT d, m, sum(amount) AS total, count(*) AS labels FROM cells GROUP BY d, m)
    , placed AS (SELECT *, row_number() OVER (PARTITION BY d, m ORDER BY amount DESC, label) AS place, row_number() OVER (PARTITION BY d, m ORDER BY amount, label) AS low,
                 row_number() OVER (PARTITION BY d, m ORDER BY round(amount, 2) DESC, label) AS first FROM cells)
    , h AS (SELECT *, epoch_us(order_date) > (SELECT median(epoch_us(order_date)) FROM sales) AS late FROM sales), sides AS ({_SIDES})
    , driver AS (SELECT m, d, CASE WHEN sum(r - p) < 0 THEN arg_min(label, struct_pack(x := r - p, l := label)) ELSE arg_min(label, struct_pack(x := p - r, l := label)) END AS label
                 FROM sides WHERE d IS NOT NULL GROUP BY m, d)
    , wanted AS (SELECT DISTINCT intent, dimension, measure, n FROM plans)
    , grouped AS (SELECT intent, dimension, measure, wanted.n, place, low, first, label, amount, total, placed.m, lines FROM wanted, placed, totals, n
                  WHERE placed.d = dimension AND totals.d = placed.d AND totals.m IS NOT DISTINCT FROM placed.m
                    AND placed.m IS NOT DISTINCT FROM CASE WHEN intent IN ('top_count', 'most_common') THEN NULL ELSE measure END)
    , a AS (
        SELECT intent, dimension, measure, wanted.n, dimension AS label, labels::DOUBLE AS value, NULL::DOUBLE AS share FROM wanted JOIN totals ON d = dimension AND m IS NULL WHERE intent = 'unique_count'
        UNION ALL SELECT intent, dimension, measure, n, label, round(amount, 2), round(amount / total * 100, 1) FROM grouped WHERE intent = 'weakest' AND low = 1
        UNION ALL SELECT intent, dimension, measure, n, label, round(amount, 2), round(round(amount / total * 100, 2), 1) FROM grouped WHERE intent IN ('leader', 'advice') AND first = 1
        UNION ALL SELECT intent, dimension, measure, n, label, round(amount, 2), round(amount / sum(amount) OVER (PARTITION BY dimension, measure, n) * 100, 1) FROM grouped WHERE intent = 'top_n' AND place <= n
        UNION ALL SELECT intent, dimension, measure, n, label, amount, round(amount * 100e0 / lines, 1) FROM grouped WHERE intent IN ('top_count', 'most_common') AND place <= n
        UNION ALL SELECT intent, dimension, measure, n, measure, CASE intent WHEN 'highest_value' THEN top WHEN 'average' THEN round(mean, 2) ELSE far END,
                  CASE intent WHEN 'average' THEN round(mid, 2) WHEN 'outliers' THEN round(far * 100e0 / (SELECT lines FROM n), 1) END
                  FROM wanted JOIN numbers ON m = measure WHERE intent IN ('highest_value', 'average', 'outliers')
        UNION ALL SELECT intent, dimension, measure, wanted.n, driver.label, round((r - p) / abs(p) * 100, 1), NULL FROM wanted JOIN sides ON sides.m = measure AND sides.d IS NULL
                  JOIN driver ON driver.m = measure AND driver.d = dimension WHERE intent = 'why_change'
        UNION ALL SELECT intent, NULL, NULL, 1, label, value, share FROM (SELECT DISTINCT intent FROM wanted) JOIN (
            {" UNION ALL ".join(f"SELECT * FROM ({_BODIES[k]})" for k in ("rows", "columns", "quality", "unknown"))}) ON answer_type = intent)
    SELECT conv_id, turn, plans.intent, label, value, share FROM plans JOIN a ON plans.intent = a.intent AND plans.dimension IS NOT DISTINCT FROM a.dimension
           AND plans.measure IS NOT DISTINCT FROM a.measure AND plans.n = a.n"""))
def qa_many(spark, sf):
    t = Tables(spark, sf)
    return ASK.ask_many(t.sales, questions(t)).select("conv_id", "turn", "intent", "label", "value", "share")


@query("qa15_conversation_context", sql("questions", """
    , q AS (SELECT conv_id, turn, trim(regexp_replace(""" + _replaced("' ' || trim(lower(question)) || ' '", L.ASSISTANT_TERMS) + """, '\\s+', ' ', 'g')) AS normalized FROM questions)
    , k AS (SELECT *, CASE WHEN regexp_matches(normalized, 'kpi|summary|health|important metric')
                             OR normalized LIKE '%why%' AND regexp_matches(normalized, 'profit|sales|revenue') THEN 'special'
                           WHEN len(string_split(normalized, ' ')) > 3 THEN 'long' ELSE 'short' END AS kind FROM q)
    , p AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM k)
    , a AS (SELECT *, max(CASE WHEN kind <> 'short' OR before IS NULL OR before = 'special' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS anchor FROM p)
    SELECT conv_id, turn, normalized, kind, CASE WHEN kind <> 'special' THEN string_agg(normalized, ' ') OVER (PARTITION BY conv_id, anchor ORDER BY turn ROWS 7 PRECEDING) END AS engine_question,
           max(turn) OVER (PARTITION BY conv_id) - turn < 8 AS remembered FROM a"""))
def qa15(spark, sf):
    asked = questions(Tables(spark, sf)).withColumnRenamed("question", "text")
    return ASK.conversation_context(asked)


# ---------------------------------------------------------------- text and language

# Every fifth text gets Hindi words, every fifth some Hinglish ones, so that the rules fire.
_MIXED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' व्यावसायिक जोखिम' WHEN 1 THEN 'mujhe batao ' || text
                                WHEN 2 THEN 'राजस्व और लाभ KPI ' || doc_id ELSE text END AS text,
                   (['en', 'hi', 'hinglish', NULL])[1 + doc_id % 4] AS code FROM documents"""
VIEWS["mixed"] = ([], _MIXED)


def mixed(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    text = (
        F.when(k == 0, F.concat("text", F.lit(" व्यावसायिक जोखिम"))).when(k == 1, F.concat(F.lit("mujhe batao "), "text"))
        .when(k == 2, F.concat(F.lit("राजस्व और लाभ KPI "), F.col("doc_id"))).otherwise(F.col("text"))
    )
    codes = F.array(F.lit("en"), F.lit("hi"), F.lit("hinglish"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", text.alias("text"), codes[(F.col("doc_id") % 4).cast("int")].alias("code"))


_LOCALE = """CASE WHEN regexp_matches(lower(text), 'english|angrezi') THEN 'en-US'
                 WHEN regexp_matches(lower(text), 'hindi|हिंदी|hinglish') OR regexp_matches(text, '[\\x{0900}-\\x{097F}]')
                      OR regexp_matches(lower(text), '""" + "|".join(L.HINGLISH_MARKERS) + "') THEN 'hi-IN' ELSE 'en-US' END"


@query("txt1_detect_language", sql("mixed", f"""
    , l AS (SELECT doc_id, text, {_LOCALE} AS locale FROM mixed)
    SELECT doc_id, locale, CASE WHEN regexp_matches(lower(text), 'hinglish') THEN 'hinglish'
           WHEN regexp_matches(lower(text), 'hindi') OR regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') THEN 'hindi'
           WHEN locale = 'hi-IN' THEN 'hinglish' ELSE 'english' END AS style FROM l"""))
def txt1(spark, sf):
    found = mixed(Tables(spark, sf)).withColumn("locale", LG.detect_language(F.col("text")))
    return found.select("doc_id", "locale", LG.response_style(F.col("text"), F.col("locale")).alias("style"))


def _purity_sql(text: str, code: str) -> str:
    words = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+')"
    allowed = ", ".join(f"'{w}'" for w in L.ALLOWED_ENGLISH_IN_HINDI)
    english = f"len(list_filter({words}, lambda w: regexp_matches(w, '[A-Za-z]') AND lower(w) NOT IN ({allowed})))"
    return f"""CASE WHEN coalesce(trim({text}), '') = '' THEN NULL
        WHEN coalesce({code}, 'en') = 'en' AND regexp_matches({text}, '[\\x{{0900}}-\\x{{097F}}]') THEN 'English output contains Hindi Unicode characters.'
        WHEN {code} = 'hi' AND {english} / greatest(len({words}), 1)::DOUBLE > 0.05e0 THEN 'Hindi output contains too much English text.'
        WHEN {code} = 'hinglish' AND regexp_matches({text}, '[\\x{{0900}}-\\x{{097F}}]') THEN 'Hinglish output contains Devanagari characters.' END"""


@query("txt2_language_purity", sql("mixed", f"SELECT doc_id, {_purity_sql('text', 'code')} AS reason FROM mixed"))
def txt2(spark, sf):
    return mixed(Tables(spark, sf)).select("doc_id", LG.purity_problem(F.col("text"), F.col("code")).alias("reason"))


@query("txt3_purity_violations", sql("mixed", f"""
    , f AS (SELECT doc_id, code, 'body' AS path, text FROM mixed
            UNION ALL SELECT doc_id, code, 'note', CASE WHEN doc_id % 3 = 0 THEN 'जोखिम ' || doc_id ELSE 'KPI SQL ' || doc_id END FROM mixed)
    , v AS (SELECT doc_id, path, {_purity_sql('text', 'code')} AS reason FROM f)
    SELECT * FROM v WHERE reason IS NOT NULL"""))
def txt3(spark, sf):
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("जोखिम "), F.col("doc_id"))).otherwise(F.concat(F.lit("KPI SQL "), F.col("doc_id")))
    fields = mixed(Tables(spark, sf)).select("doc_id", "code", F.col("text").alias("body"), note.alias("note"))
    return LG.purity_violations(fields, ["doc_id"], ["body", "note"], F.col("code"))


_SENTENCE = """'Recommended action: Assign an owner. High revenue_risk for ' || event_type || ', ' || event_id || ' rows and 3 customers; focus on growth trends before using missing values.'"""
VIEWS["sentences"] = ([], f"SELECT event_id, {_SENTENCE} AS text FROM events")


def _localized_sql(language: str) -> str:
    out = _replaced("replace(text, '_', ' ')", L.DISPLAY_PHRASES.get(language, []))
    for pattern, target in L.WORD_PATTERNS[language]:
        out = f"regexp_replace({out}, '{pattern}', '{target.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query("txt4_localize_text", sql("sentences", f"SELECT event_id, {_localized_sql('hi')} AS hi, {_localized_sql('hinglish')} AS hinglish, {_localized_sql('en')} AS en FROM sentences"))
def txt4(spark, sf):
    e = Tables(spark, sf).events
    text = F.concat(
        F.lit("Recommended action: Assign an owner. High revenue_risk for "), "event_type", F.lit(", "), F.col("event_id"),
        F.lit(" rows and 3 customers; focus on growth trends before using missing values."),
    )
    return e.select("event_id", *[LG.localize_text(text, code).alias(code) for code in ("hi", "hinglish", "en")])


# ---------------------------------------------------------------- bookkeeping

VIEWS["uploads"] = ([], """
    SELECT o_orderkey AS upload_id, o_custkey AS user_id, 'file_' || (o_orderkey % 700) || '.csv' AS filename,
           o_orderpriority AS summary, o_orderdate::TIMESTAMP AS created_at FROM orders""")
VIEWS["users"] = (["uploads"], """
    SELECT c_custkey AS user_id, c_name || '@example.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN p.upload_id END AS latest_upload_id
    FROM customer LEFT JOIN (SELECT user_id, min(upload_id) AS upload_id FROM uploads GROUP BY 1) p ON p.user_id = c_custkey""")


def uploads(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("file_"), (F.col("o_orderkey") % 700).cast("string"), F.lit(".csv")).alias("filename"),
        F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").alias("created_at"),
    )


def users(t: Tables) -> DataFrame:
    first = uploads(t).groupBy("user_id").agg(F.min("upload_id").alias("p"))
    named = t.customer.select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@example.org")).alias("email"))
    return named.join(first, "user_id", "left").select(
        "user_id", "email", F.when(F.col("user_id") % 3 == 0, F.col("p")).alias("latest_upload_id")
    )


@query("j1_left_join", """
    SELECT l_orderkey, l_linenumber, l_quantity, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem LEFT JOIN
    (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS o_orderdate FROM orders) ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL""")
def j1(spark, sf):
    t = Tables(spark, sf)
    times = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return RL.attach_left(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), times, ["l_orderkey"], "day")


@query("j2_inner_join", sql("users", """
    SELECT o_orderkey AS ticket_id, u.user_id, email, o_orderstatus AS status FROM orders JOIN users u ON o_custkey = u.user_id"""))
def j2(spark, sf):
    t = Tables(spark, sf)
    tickets = t.orders.select(
        F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return RL.tickets_with_users(tickets, users(t)).drop("created_at")


@query("j3_left_join_count", sql("users", """
    SELECT u.user_id, u.email, count(p.upload_id) AS total_uploads FROM users u LEFT JOIN uploads p ON p.user_id = u.user_id GROUP BY 1, 2"""))
def j3(spark, sf):
    t = Tables(spark, sf)
    return RL.users_with_upload_counts(users(t).drop("latest_upload_id"), uploads(t))


@query("j4_latest_per_key", sql("users", """
    , r AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY (p.upload_id = u.latest_upload_id) IS TRUE DESC, created_at DESC, p.upload_id DESC) AS k
            FROM uploads p JOIN users u ON u.user_id = p.user_id)
    SELECT user_id, upload_id, filename FROM r WHERE k = 1"""))
def j4(spark, sf):
    t = Tables(spark, sf)
    return RL.latest_upload(uploads(t), users(t)).select("user_id", "upload_id", "filename")


@query("j5_recent_uploads", sql("uploads", """
    SELECT user_id, upload_id, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id DESC) AS k FROM uploads) WHERE k <= 10"""))
def j5(spark, sf):
    return RL.recent_uploads(uploads(Tables(spark, sf))).select("user_id", "upload_id", "rank")


@query("j5_search_history", sql("uploads", """
    SELECT upload_id, filename, summary, upload_id % 100 = 0 AS pinned FROM uploads WHERE lower(filename) LIKE '%urgent%' OR lower(summary) LIKE '%urgent%'
    ORDER BY pinned DESC, created_at DESC, upload_id DESC"""))
def j5b(spark, sf):
    found = RL.search_history(uploads(Tables(spark, sf)), "URGENT", F.col("upload_id") % 100 == 0)
    return found.select("upload_id", "filename", "summary", "pinned")


_DOOMED = ", d AS (SELECT o_orderkey AS upload_id FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 700 < 90)"


@query("j6_delete_history", sql("uploads", _DOOMED + " SELECT upload_id, filename FROM uploads WHERE upload_id NOT IN (SELECT upload_id FROM d)"))
def j6(spark, sf):
    t = Tables(spark, sf)
    doomed = t.orders.where("o_orderstatus = 'F' OR o_orderkey % 700 < 90").select(F.col("o_orderkey").alias("upload_id"))
    return RL.delete_uploads(uploads(t), doomed)[0].select("upload_id", "filename")


@query("j6_unused_files", sql("uploads", _DOOMED + """
    SELECT DISTINCT filename FROM uploads WHERE upload_id IN (SELECT upload_id FROM d)
    AND filename NOT IN (SELECT filename FROM uploads WHERE upload_id NOT IN (SELECT upload_id FROM d))"""))
def j6b(spark, sf):
    t = Tables(spark, sf)
    doomed = t.orders.where("o_orderstatus = 'F' OR o_orderkey % 700 < 90").select(F.col("o_orderkey").alias("upload_id"))
    return RL.delete_uploads(uploads(t), doomed)[1]


@query("j7_aligned_delta", """
    WITH e AS (SELECT user_id, value, ts < TIMESTAMP '2024-01-02' AS early FROM events)
    SELECT user_id, round(coalesce(sum(value) FILTER (WHERE early), 0), 4) AS before, round(coalesce(sum(value) FILTER (WHERE NOT early), 0), 4) AS after FROM e GROUP BY 1""")
def j7(spark, sf):
    e = Tables(spark, sf).events
    cut = F.lit("2024-01-02").cast("timestamp")
    found = RL.aligned_delta(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "user_id", "value")
    return found.select("user_id", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query("s1_set_ops", "SELECT event_id FROM events WHERE value > 40 UNION SELECT event_id FROM events WHERE event_type = 'error'")
def s1(spark, sf):
    e = Tables(spark, sf).events
    return RL.flagged_union([e.where("value > 40").select("event_id"), e.where("event_type = 'error'").select("event_id")])


@query("s2_top_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def s2(spark, sf):
    return RL.top_rows(Tables(spark, sf).events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 20)


# ---------------------------------------------------------------- metering

LIMITS = [("click", 2, "daily"), ("view", 3, "daily"), ("purchase", 12, "monthly"), ("error", 15, "lifetime"), ("signup", None, "daily")]


def usage_events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", F.col("event_type").alias("feature"), "ts")


_KEYS = """
    WITH k AS (SELECT user_id, event_type AS feature, unnest(['daily', 'monthly', 'lifetime']) AS period, ts FROM events)
    , u AS (SELECT user_id, feature, period, CASE period WHEN 'daily' THEN strftime(ts, '%Y-%m-%d') WHEN 'monthly' THEN strftime(ts, '%Y-%m') ELSE 'lifetime' END AS period_key,
                   count(*) AS used FROM k GROUP BY 1, 2, 3, 4)"""


@query("u1_usage_metering", _KEYS + " SELECT * FROM u")
def u1(spark, sf):
    return U.usage_metering(usage_events(Tables(spark, sf)))


@query("u2_quota_check", _KEYS + """
    , l AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', {'NULL' if n is None else n}::BIGINT, '{p}')" for f, n, p in LIMITS) + """) v(feature, quota, period))
    , q AS (SELECT user_id, feature, period, period_key, used, CASE WHEN user_id % 7 <> 0 THEN quota END AS quota FROM u JOIN l USING (feature, period))
    SELECT *, greatest(quota - used, 0) AS remaining, quota IS NULL AS unlimited, coalesce(used >= quota, false) AS blocked
    FROM (SELECT user_id, feature, period, period_key, used, quota FROM q)""".replace("greatest(quota - used, 0)", "CASE WHEN quota IS NOT NULL THEN greatest(quota - used, 0) END"))
def u2(spark, sf):
    e = usage_events(Tables(spark, sf))
    premium = e.where("user_id % 7 = 0").select("user_id")
    return U.quota_check(e, U.limits_frame(spark, LIMITS), premium)


@query("u3_plan_expiry", """
    WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'premium' ELSE 'free' END AS plan,
                      (SELECT max(o_orderdate)::TIMESTAMP FROM orders) + to_hours((c_custkey % 400)::INT - 200) AS e, (SELECT max(o_orderdate)::TIMESTAMP FROM orders) AS n FROM customer)
    SELECT user_id, plan, CASE WHEN plan = 'premium' AND n > e + INTERVAL 3 DAY THEN 'free' ELSE plan END AS effective_plan,
           greatest(ceil((epoch_us(e) - epoch_us(n)) / 86400000000), 0)::BIGINT AS days_left FROM p""")
def u3(spark, sf):
    t = Tables(spark, sf)
    now = t.orders.agg(F.max("o_orderdate").alias("n")).scalar()
    hours = (F.col("user_id") % 400 - 200).cast("int")
    people = t.customer.select(F.col("c_custkey").alias("user_id")).withColumn("n", now).select(
        "user_id", F.when(F.col("user_id") % 2 == 0, "premium").otherwise("free").alias("plan"), "n",
        (F.col("n") + F.make_dt_interval(hours=hours)).alias("subscription_end"),
    )
    return U.plan_expiry(people, F.col("n"))


@query("u4_rate_limit", """
    SELECT event_id, count(*) OVER w - 1 AS recent, count(*) OVER w - 1 >= 3 AS over_limit FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def u4(spark, sf):
    found = U.rate_limit(usage_events(Tables(spark, sf)), limit=3, window_seconds=86400, slice_seconds=7 * 86400)
    return found.select("event_id", "recent", "over_limit")


@query("u4_rate_limit_exact", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, event_id, i, true AS accepted, [t] AS times FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_id, e.i, len(list_filter(s.times, lambda x: e.t - x <= 86400000000)) < 3,
                 CASE WHEN len(list_filter(s.times, lambda x: e.t - x <= 86400000000)) < 3
                      THEN list_append(list_filter(s.times, lambda x: e.t - x <= 86400000000), e.t)
                      ELSE list_filter(s.times, lambda x: e.t - x <= 86400000000) END
          FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, event_id, accepted FROM s""")
def u4b(spark, sf):
    return U.rate_limit_exact(usage_events(Tables(spark, sf)), limit=3, window_seconds=86400).drop("ts")


# ---------------------------------------------------------------- streams

def event_stream(spark, sf) -> DataFrame:
    return ST.file_stream(spark, sf, "events").withColumnRenamed("event_type", "feature")


@query("st1_stream_usage", """
    SELECT user_id, event_type AS feature, strftime(ts, '%Y-%m-%d') AS period_key, count(*) AS used FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3""")
def st1(spark, sf):
    return ST.run_available(ST.stream_usage(event_stream(spark, sf)), scratch_folder(spark))


@query("st2_stream_rate_limit", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, event_id, i, true AS accepted, [t] AS times FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_id, e.i, len(list_filter(s.times, lambda x: e.t - x <= 86400000000)) < 3,
                 CASE WHEN len(list_filter(s.times, lambda x: e.t - x <= 86400000000)) < 3
                      THEN list_append(list_filter(s.times, lambda x: e.t - x <= 86400000000), e.t)
                      ELSE list_filter(s.times, lambda x: e.t - x <= 86400000000) END
          FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, event_id, accepted FROM s""")
def st2(spark, sf):
    judged = ST.stream_rate_limit(event_stream(spark, sf), limit=3, window_seconds=86400)
    return ST.run_available(judged, scratch_folder(spark)).drop("ts")


@query("st3_stream_dedup", "SELECT count(DISTINCT user_id || '-' || event_type) AS uploads FROM events")
def st3(spark, sf):
    hashed = event_stream(spark, sf).withColumn("dataset_hash", F.concat_ws("-", "user_id", "feature"))
    kept = ST.run_available(ST.stream_dedup(hashed, delay="90 days"), scratch_folder(spark))
    return kept.agg(F.count(F.lit(1)).alias("uploads"))


@query("st4_stream_trend", """
    WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 4) AS total, n AS records, round((v - lag(v) OVER (ORDER BY day)) / abs(lag(v) OVER (ORDER BY day)) * 100, 2) AS growth_percent FROM d""")
def st4(spark, sf):
    days = ST.stream_trend(event_stream(spark, sf), scratch_folder(spark))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("total", 4).alias("total"), "records", "growth_percent")
