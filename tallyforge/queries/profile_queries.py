"""Sources, normalisation, profiling and cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


from tallyforge.functions.text import format_value, humanize, numeric_from_text, timestamp_from_text
from tallyforge.operators import backbone as B, clean as C, normalize as N, profile as P
from tallyforge.queries.base import Tables, query, scratch_folder, sql
from tallyforge.session import staged_table
from tallyforge.sources import fingerprint as FP, readers as R, writers as Wr

NUMBERS = ["quantity", "revenue", "discount", "cost"]
TEXTS = ["customer_name", "product_name", "category", "region"]
HOLED_NUMBERS = ["quantity", "revenue", "discount"]


def union_sql(columns: list[str], template: str) -> str:
    """The template once per column, joined by UNION ALL."""
    return " UNION ALL ".join(template.format(c=c) for c in columns)


# ---------------------------------------------------------------- sources and sinks

@query("src1_read_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def src1(spark, sf):
    path = f"{scratch_folder(spark)}/customer.csv"
    Wr.write_csv(Tables(spark, sf).customer, path)
    return R.read_csv(spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"),
    )


@query("src2_read_json", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def src2(spark, sf):
    path = f"{scratch_folder(spark)}/part.json"
    packed = Tables(spark, sf).part.select(F.struct("p_partkey", "p_name", "p_size").alias("r"))
    chunks = packed.groupBy((F.col("r.p_partkey") / 1000).cast("long").alias("chunk")).agg(F.collect_list("r").alias("rows"))
    # Each file holds one JSON array of at most 1000 records.
    chunks.select("chunk", F.to_json("rows").alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)
    return R.read_json(spark, path).select("p_partkey", "p_name", "p_size")


@query("src2_read_json_columns", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def src2_columns(spark, sf):
    path = f"{scratch_folder(spark)}/part_columns.json"
    names = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    chunks = Tables(spark, sf).part.groupBy((F.col("p_partkey") / 1000).cast("long").alias("chunk")).agg(F.collect_list(F.struct(*names)).alias("rows"))
    lists = F.to_json(F.struct(*[F.col(f"rows.{c}").alias(c) for c in names]))
    keys = F.transform("rows", lambda r: r["p_partkey"].cast("string"))
    objects = F.to_json(F.struct(*[F.map_from_arrays(keys, F.col(f"rows.{c}")).alias(c) for c in names]))
    # Files in turn hold an object of arrays and an object of objects keyed by row.
    chunks.select("chunk", F.when(F.col("chunk") % 2 == 0, lists).otherwise(objects).alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)
    return R.read_json(spark, path).select(*names)


def workbook(rows: list[list]) -> bytes:
    """A minimal workbook with one sheet of inline texts, as input for the reader."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    lines = "".join(
        "<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in row) + "</row>" for row in rows
    )
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{lines}</sheetData></worksheet>")
    return out.getvalue()


@query("src3_read_excel", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def src3(spark, sf):
    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        return pd.Series([workbook([["c_custkey", "c_name"], *[[r["c_custkey"], r["c_name"]] for r in rows]]) for rows in batch])

    # Workbooks of at most 500 customers.
    chunk = F.floor(F.col("c_custkey") / 500)
    packed = Tables(spark, sf).customer.groupBy(chunk.cast("string").alias("path")).agg(
        F.collect_list(F.struct("c_custkey", "c_name")).alias("rows"))
    files = packed.select("path", pack("rows").alias("content"))
    return R.parse_workbooks(files, ["c_custkey", "c_name"]).drop("source_file")


@query("src4_read_table", "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def src4(spark, sf):
    return R.read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query("src5_reject_empty", "SELECT count(*) AS rows FROM supplier")
def src5(spark, sf):
    return R.reject_empty(Tables(spark, sf).supplier).agg(F.count(F.lit(1)).alias("rows"))


_TEXT = "coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


@query("src6_dataset_fingerprint", f"""
    SELECT count(*) AS rows, sum(('0x' || substr(sha256(concat_ws('|', {', '.join(_TEXT.format(c=c) for c in
    ('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority'))})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS content_hash
    FROM orders""")
def src6(spark, sf):
    return FP.table_fingerprint(
        Tables(spark, sf).orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], method="sha2"
    )


@query("src6_cached_results", """
    WITH h AS (SELECT o_custkey AS user_id, o_orderpriority AS dataset_hash, o_orderdate AS created_at, o_orderkey AS result_id
               FROM orders WHERE o_orderstatus <> 'P'),
    u AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS dataset_hash FROM orders WHERE o_orderstatus = 'P')
    SELECT u.user_id, u.dataset_hash, arg_max(h.result_id, struct_pack(a := h.created_at, b := h.result_id)) AS result_id
    FROM u JOIN h USING (user_id, dataset_hash) GROUP BY ALL""")
def src6b(spark, sf):
    o = Tables(spark, sf).orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dataset_hash"), "o_orderstatus",
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("result_id"), F.lit("v1").alias("version"),
    )
    open_now = o.where("o_orderstatus = 'P'").select("user_id", "dataset_hash").distinct()
    return FP.cached_results(open_now, o.where("o_orderstatus <> 'P'"))


@query("snk1_write_csv", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def snk1(spark, sf):
    path = f"{scratch_folder(spark)}/supplier.csv"
    Wr.write_csv(Tables(spark, sf).supplier, path)
    schema = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    return spark.read.csv(path, header=True, schema=schema).select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("snk2_persist_analysis", """
    SELECT l_suppkey::VARCHAR AS supplier, count(*) AS records, '1' AS dataset_id FROM lineitem GROUP BY 1""")
def snk2(spark, sf):
    path = scratch_folder(spark)
    counts = Tables(spark, sf).lineitem.groupBy(F.col("l_suppkey").cast("string").alias("supplier")).agg(
        F.count(F.lit(1)).alias("records")
    )
    Wr.persist_sections({"counts": counts}, path, "1")
    return Wr.read_section(spark, path, "counts", None).withColumn("dataset_id", F.col("dataset_id").cast("string"))


# ---------------------------------------------------------------- normalisation

@query("nrm1_sanitize_columns", "SELECT r_regionkey AS \"Region Key\", r_name AS \"Region Key_2\" FROM region")
def nrm1(spark, sf):
    return N.sanitize_columns(Tables(spark, sf).region.toDF(" Region  Key ", "Region Key"))


@query("nrm2_snake_columns", "SELECT n_nationkey AS nation_key, n_name AS nation_key_2, n_regionkey AS region FROM nation")
def nrm2(spark, sf):
    return N.snake_columns(Tables(spark, sf).nation.toDF("Nation Key!", "nation-key", " (Region) "))


@query("nrm3_trim_strings", sql("dirty", "SELECT category, count(*) AS records FROM (SELECT trim(category) AS category FROM dirty) GROUP BY 1"))
def nrm3(spark, sf):
    return N.trim_strings(Tables(spark, sf).dirty).groupBy("category").agg(F.count(F.lit(1)).alias("records"))


@query("nrm4_parse_numeric_text", sql("dirty", """
    SELECT order_id, line_no, try_cast(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price FROM dirty"""))
def nrm4(spark, sf):
    return Tables(spark, sf).dirty.select("order_id", "line_no", numeric_from_text(F.col("price")).alias("price"))


@query("nrm4_parse_ratios", sql("dirty", """
    , t AS (SELECT trim(ship_date) AS ship_date, trim(category) AS category, trim(price) AS price, flag, note FROM dirty)
    """ + union_sql(["ship_date", "category", "price", "flag", "note"], """
    SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null,
           count(try_cast(replace(replace({c}, '$', ''), ',', '') AS DOUBLE)) AS numeric,
           count(try_strptime({c}, '%Y-%m-%d')) AS dates FROM t""")))
def nrm4b(spark, sf):
    return N.parse_ratios(N.trim_strings(Tables(spark, sf).dirty))


@query("nrm5_parse_datetime_text", sql("dirty", """
    SELECT order_id, line_no, strftime(try_strptime(ship_date, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM dirty"""))
def nrm5(spark, sf):
    day = F.date_format(timestamp_from_text(F.col("ship_date")), "yyyy-MM-dd")
    return Tables(spark, sf).dirty.select("order_id", "line_no", day.alias("day"))


@query("nrm6_empty_columns", sql("dirty", union_sql(["ship_date", "category", "price", "quantity", "flag", "note"], """
    SELECT '{c}' AS "column" FROM dirty HAVING count({c}) = 0""")))
def nrm6(spark, sf):
    return N.empty_columns(Tables(spark, sf).dirty)


@query("nrm7_json_safe", """
    SELECT event_id, CASE WHEN event_id % 10 > 1 THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events""")
def nrm7(spark, sf):
    k = F.col("event_id") % 10
    broken = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value"))
    return N.json_safe(Tables(spark, sf).events.select("event_id", broken.alias("value"), "ts"))


@query("nrm8_humanize", """
    SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) || ' Event' AS label FROM events""")
def nrm8(spark, sf):
    return Tables(spark, sf).events.select("event_id", humanize(F.concat("event_type", F.lit("_event"))).alias("label"))


@query("nrm9_format_value", """
    SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 100000 THEN format('{:.2f} lakh', o_totalprice / 100000e0)
                            ELSE format('{:,.2f}', o_totalprice) END AS label FROM orders""")
def nrm9(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", format_value(F.col("o_totalprice")).alias("label"))


# ---------------------------------------------------------------- profiling

@query("prf1_shape", sql("sales", "SELECT count(*) AS rows, 10::BIGINT AS columns FROM sales"))
def prf1(spark, sf):
    return P.shape(Tables(spark, sf).sales)


HOLED_COLUMNS = ["order_id", "order_date", "region", "category", "quantity", "revenue", "discount"]


@query("prf2_missing_by_column", sql("holed", union_sql(HOLED_COLUMNS, """
    SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
           round((count(*) - count({c})) * 100e0 / greatest(count(*), 1), 1) AS missing_percent FROM holed""")))
def prf2(spark, sf):
    return P.missing_by_column(Tables(spark, sf).holed)


_CELLS = " + ".join(f"(count(*) - count({c}))" for c in HOLED_COLUMNS)


@query("prf3_missing_summary", sql("holed", f"""
    SELECT ({_CELLS})::BIGINT AS missing_cells,
           count(*) FILTER (WHERE region IS NULL OR quantity IS NULL OR discount IS NULL) AS missing_rows,
           3::BIGINT AS missing_columns, round(({_CELLS}) * 100e0 / (count(*) * 7), 4) AS missing_percentage FROM holed"""))
def prf3(spark, sf):
    return P.missing_summary(Tables(spark, sf).holed)


_DUP = ", g AS (SELECT count(*) AS n FROM dirty GROUP BY order_id, line_no, ship_date, category, price, quantity, flag, note)"


@query("prf4_duplicate_rows", sql("dirty", f"""
    {_DUP} SELECT sum(n - 1)::BIGINT AS duplicate_rows, round(sum(n - 1) * 100e0 / sum(n), 4) AS duplicate_percent FROM g"""))
def prf4(spark, sf):
    return P.duplicate_rows(Tables(spark, sf).dirty)


@query("prf4_duplicate_groups", sql("dirty", """
    SELECT order_id, line_no, count(*) AS copies FROM dirty
    GROUP BY order_id, line_no, ship_date, category, price, quantity, flag, note HAVING count(*) > 1"""))
def prf4b(spark, sf):
    return B.duplicate_groups(Tables(spark, sf).dirty).select("order_id", "line_no", "copies")


_Q = "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3"


@query("prf5_describe_numeric", sql("holed", union_sql(HOLED_NUMBERS, """
    SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
           round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM holed""")))
def prf5(spark, sf):
    return P.describe_numeric(Tables(spark, sf).holed, HOLED_NUMBERS)


@query("prf6_numeric_kpis", sql("holed", union_sql(HOLED_NUMBERS, """
    SELECT '{c}' AS "column", round(sum({c}), 2) AS total, round(avg({c}), 2) AS mean,
           round(quantile_cont({c}, 0.5), 2) AS median, round(min({c}), 2) AS min, round(max({c}), 2) AS max,
           round(stddev_samp({c}), 2) AS std, round(var_samp({c}), 2) AS variance,
           count(*) - count({c}) AS missing_count, count({c}) AS non_null_count FROM holed""")))
def prf6(spark, sf):
    return P.numeric_kpis(Tables(spark, sf).holed)


@query("prf7_distribution", sql("holed", union_sql(HOLED_NUMBERS, """
    SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
           round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS p25,
           round(quantile_cont({c}, 0.75), 4) AS p75, round(skewness({c}), 4) AS skew FROM holed""")))
def prf7(spark, sf):
    return P.distribution(Tables(spark, sf).holed, HOLED_NUMBERS)


_TOP = """
    , f AS ({union})
    , r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k,
                   sum(n) OVER (PARTITION BY "column") AS t, count(*) OVER (PARTITION BY "column") AS u FROM f)"""


def freq_sql(view: str, columns: list[str]) -> str:
    return _TOP.format(union=union_sql(columns, """
        SELECT '{c}' AS "column", {c}::VARCHAR AS v, count(*) AS n FROM """ + view + """ WHERE {c} IS NOT NULL GROUP BY 2"""))


@query("prf8_category_summary", sql("holed", freq_sql("holed", ["region", "category"]) + """
    SELECT "column", v AS top_value, round(n * 100e0 / t, 1) AS top_share, u AS unique_count FROM r WHERE k = 1"""))
def prf8(spark, sf):
    return P.category_summary(Tables(spark, sf).holed)


@query("prf9_categorical_kpis", sql("sales", freq_sql("sales", TEXTS) + """
    SELECT "column", v AS top_category, n AS top_category_count, round(n * 100e0 / t, 4) AS top_category_percentage,
           u AS unique_count, t::BIGINT AS non_null_count FROM r WHERE k = 1"""))
def prf9(spark, sf):
    return P.categorical_kpis(Tables(spark, sf).sales)


SALES_COLUMNS = ["order_id", "order_date", *TEXTS, "quantity", "revenue", "discount", "cost"]


@query("prf10_cardinality", sql("sales", union_sql(["order_id", "customer_name", "product_name", "category", "region", "discount"], """
    SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
           round(count(DISTINCT {c}) / count(*)::DOUBLE, 4) AS cardinality_ratio FROM sales""")))
def prf10(spark, sf):
    return P.cardinality(
        Tables(spark, sf).sales, ["order_id", "customer_name", "product_name", "category", "region", "discount"]
    )


_SEMANTIC = {  # fixed by name and physical type; only the listed rules depend on the counts
    "order_id": "'id'", "order_date": "'datetime'", "region": "'location'",
    "category": "CASE WHEN u <= least(50, n * 0.5) THEN 'categorical' ELSE 'text' END",
    "quantity": "CASE WHEN u / n > 0.9 THEN 'id' ELSE 'numeric' END",
    "revenue": "CASE WHEN u / n > 0.9 THEN 'id' ELSE 'currency' END",
    "discount": "CASE WHEN u / n > 0.9 THEN 'id' ELSE 'numeric' END",
}


@query("prf11_infer_semantic_schema", sql("holed", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {rule} AS semantic_type, k AS non_null_count, n - k AS missing_count,
           round((n - k) * 100e0 / n, 2) AS missing_percent, u AS unique_count
    FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM holed)""" for c, rule in _SEMANTIC.items())))
def prf11(spark, sf):
    return P.infer_semantic_schema(Tables(spark, sf).holed)


_ANALYTIC = {
    "order_id": ("'identifier'", "'other'", False), "order_date": ("'datetime'", "'datetime'", False),
    "region": ("CASE WHEN u <= least(50, greatest(2, n * 0.4)) THEN 'dimension' ELSE 'text' END", "'categorical'", False),
    "category": ("CASE WHEN u <= least(50, greatest(2, n * 0.4)) THEN 'dimension' ELSE 'text' END", "'categorical'", False),
    "quantity": ("'volume'", "'numeric'", True), "revenue": ("'money'", "'numeric'", True),
    "discount": ("'volume'", "'numeric'", True),
}


def _inspect_sql(c: str, kind: str, group: str, measure: bool) -> str:
    stats = {"total": "sum", "mean": "avg", "median": "median", "min": "min", "max": "max", "std": "stddev_samp"}
    cols = ", ".join(f"round({f}({c}), 4) AS {n}" if measure else f"NULL::DOUBLE AS {n}" for n, f in stats.items())
    return f"""
    SELECT '{c}' AS "column", {kind} AS analytic_type, {group} AS column_group, n - k AS missing_count, u AS unique_count,
           round(u / n::DOUBLE, 4) AS cardinality_ratio, round(k / n::DOUBLE, 4) AS completeness,
           total, mean, median, min, max, std
    FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, {cols} FROM holed)"""


@query("prf12_inspect_dataset", sql("holed", " UNION ALL ".join(_inspect_sql(c, *v) for c, v in _ANALYTIC.items())))
def prf12(spark, sf):
    return P.inspect_dataset(Tables(spark, sf).holed)


@query("prf13_column_flags", sql("holed", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {c == 'order_id'} AS is_id, {c == 'order_date'} AS is_date, false AS is_boolean,
           {c in HOLED_NUMBERS + ['order_id']} AS is_numeric, {c == 'order_id'} AS is_integer, {c in HOLED_NUMBERS} AS is_float,
           {c not in HOLED_NUMBERS + ['order_id']} AND count(DISTINCT {c}) < greatest(50, count(*) * 0.5) AS is_categorical,
           {c in ('region', 'category')} AND count({c}) > 0 AS is_text,
           count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count FROM holed""" for c in HOLED_COLUMNS)))
def prf13(spark, sf):
    return P.column_flags(Tables(spark, sf).holed)


@query("prf14_validation_report", sql("dirty", _DUP + """
    SELECT 'medium' AS severity, 'missing_values' AS type, NULL::VARCHAR AS "column",
           (3 * count(*) - count(quantity) - count(flag) - count(note)) || ' cells are missing.' AS message FROM dirty
    UNION ALL SELECT 'medium', 'duplicate_rows', NULL, sum(n - 1)::BIGINT || ' duplicate rows detected.' FROM g
    UNION ALL SELECT 'high', 'empty_column', 'note', 'note is completely empty.'
    UNION ALL SELECT 'high', 'duplicate_column', 'price', 'price appeared more than once and was renamed.'"""))
def prf14(spark, sf):
    return P.validation_report(Tables(spark, sf).dirty, ["price"])


@query("prf15_map_semantic_columns", sql("holed", """
    , t AS (""" + " UNION ALL ".join(f"""SELECT '{c}' AS c, {rule} AS semantic_type
    FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM holed)""" for c, rule in _SEMANTIC.items()) + """)
    SELECT semantic_type, string_agg(c, ',' ORDER BY c) AS columns FROM t GROUP BY 1"""))
def prf15(spark, sf):
    mapped = P.map_semantic_columns(P.infer_semantic_schema(Tables(spark, sf).holed))
    return mapped.select("semantic_type", F.array_join("columns", ",").alias("columns"))


# Revenue to the power of two has a long tail, so the bounds catch something.
TAILED = ", t AS (SELECT quantity, revenue * revenue / 1e6 AS tail, discount FROM holed)"


def tailed(spark, sf) -> DataFrame:
    h = Tables(spark, sf).holed
    return h.select("quantity", (F.col("revenue") * F.col("revenue") / 1e6).alias("tail"), "discount")


_BOUNDS = TAILED + ", b AS (" + union_sql(["quantity", "tail", "discount"], """
    SELECT '{c}' AS "column", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t""") + """)
    , w AS (SELECT "column", q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM b)"""


@query("prf16_iqr_bounds", sql("holed", _BOUNDS + union_sql(["quantity", "tail", "discount"], """
    SELECT '{c}' AS "column", round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
           count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers FROM t, w WHERE w."column" = '{c}'""")))
def prf16(spark, sf):
    return P.outlier_counts(tailed(spark, sf))


_OUT = ", o AS (SELECT count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(
    f"coalesce({c} < (SELECT lo FROM w WHERE \"column\" = '{c}') OR {c} > (SELECT hi FROM w WHERE \"column\" = '{c}'), false)"
    for c in ("quantity", "tail", "discount")) + """) AS outlier_rows,
    (2 * count(*) - count(quantity) - count(discount)) AS missing_cells FROM t)
    , d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY quantity, tail, discount))"""


@query("prf17_health_score_weighted", sql("holed", _BOUNDS + _OUT + """
    SELECT round(missing_cells / (n * 3e0), 6) AS missing_penalty, round(dup / n::DOUBLE, 6) AS duplicate_penalty,
           0e0 AS invalid_penalty, round(outlier_rows / n::DOUBLE, 6) AS outlier_penalty,
           round((1 - (missing_cells / (n * 3e0) * 0.4e0 + dup / n::DOUBLE * 0.3e0 + outlier_rows / n::DOUBLE * 0.1e0)) * 100, 4)
           AS health_score FROM o, d"""))
def prf17(spark, sf):
    return P.health_score_weighted(tailed(spark, sf))


@query("prf18_dataset_health", sql("holed", _BOUNDS + _OUT + """
    , p AS (SELECT round(missing_cells * 100e0 / (n * 3), 2) AS m, round(dup * 100e0 / n, 2) AS u,
                   round(outlier_rows * 100e0 / n, 2) AS x FROM o, d)
    SELECT m AS missing_percent, u AS duplicate_percent, x AS outlier_percent,
           round(greatest(0, 100 - m * 0.45e0 - u * 0.35e0 - x * 0.2e0), 2) AS overall_health_score FROM p"""))
def prf18(spark, sf):
    return P.dataset_health(tailed(spark, sf))


@query("prf18_column_quality", sql("holed", union_sql(HOLED_COLUMNS, """
    SELECT '{c}' AS "column", round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_percent,
           round(100 - round((count(*) - count({c})) * 100e0 / count(*), 2), 2) AS quality_score FROM holed""")))
def prf18b(spark, sf):
    return P.column_quality(Tables(spark, sf).holed)


@query("prf19_quality_score", sql("dirty", _DUP + """
    , f AS (SELECT count(*) AS rows, (3 * count(*) - count(quantity) - count(flag) - count(note)) AS m FROM dirty)
    SELECT rows, m AS missing_cells, (SELECT sum(n - 1)::BIGINT FROM g) AS duplicate_rows, 1::BIGINT AS empty_columns,
           round(100 - (m / (rows * 8e0) * 45 + (SELECT sum(n - 1) FROM g) / rows::DOUBLE * 35 + 1 / 8e0 * 20), 2) AS quality_score
    FROM f"""))
def prf19(spark, sf):
    return P.quality_score(Tables(spark, sf).dirty)


@query("prf20_null_matrix", sql("holed", "SELECT " + " || ".join(f"({c} IS NULL)::INT::VARCHAR" for c in HOLED_COLUMNS) + """
    AS null_pattern, count(*) AS rows FROM holed GROUP BY 1"""))
def prf20(spark, sf):
    return P.null_matrix(Tables(spark, sf).holed)


@query("prf23_missing_hotspots", sql("holed", ", t AS (" + union_sql(HOLED_COLUMNS, """
    SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
           round((count(*) - count({c})) * 100e0 / count(*), 1) AS missing_percent FROM holed""") + """)
    SELECT * FROM t ORDER BY missing_percent DESC, "column" LIMIT 3"""))
def prf23(spark, sf):
    return P.missing_hotspots(Tables(spark, sf).holed)


@query("prf28_before_after", sql("dirty", _DUP + """
    , b AS (SELECT count(*) AS n, 3 * count(*) - count(quantity) - count(flag) - count(note) AS m FROM dirty)
    , u AS (SELECT DISTINCT * FROM dirty)
    , a AS (SELECT count(*) AS n, 3 * count(*) - count(quantity) - count(flag) - count(note) AS m FROM u)
    SELECT b.n - a.n AS rows_removed, (SELECT sum(n - 1)::BIGINT FROM g) AS duplicates_removed,
           round(b.m * 100e0 / (b.n * 8), 4) AS missing_before, round(a.m * 100e0 / (a.n * 8), 4) AS missing_after,
           round(round(a.m * 100e0 / (a.n * 8), 4) - round(b.m * 100e0 / (b.n * 8), 4), 4) AS missing_improvement FROM a, b"""))
def prf28(spark, sf):
    dirty = Tables(spark, sf).dirty
    return P.before_after(dirty, C.drop_duplicates(dirty))


# ---------------------------------------------------------------- cleaning

@query("cln1_drop_duplicates", sql("dirty", "SELECT DISTINCT * FROM dirty"))
def cln1(spark, sf):
    return C.drop_duplicates(Tables(spark, sf).dirty)


_MODE = "(SELECT {c} FROM {v} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("cln2_fill_missing", sql("holed", f"""
    SELECT order_id, strftime(order_date, '%Y-%m-%d') AS day, coalesce(region, {_MODE.format(c='region', v='holed')}) AS region,
           category, coalesce(quantity, (SELECT median(quantity) FROM holed)) AS quantity, round(revenue, 5) AS revenue,
           coalesce(discount, (SELECT median(discount) FROM holed)) AS discount FROM holed"""))
def cln2(spark, sf):
    filled = C.fill_missing(Tables(spark, sf).holed)
    return filled.select(
        F.col("order_id").cast("long").alias("order_id"), F.date_format("order_date", "yyyy-MM-dd").alias("day"), "region",
        "category", "quantity", F.round("revenue", 5).alias("revenue"), "discount",
    )


# A cube of revenue has values beyond 3 IQR, in less than 2 % of the rows.
_CUBE = ", t AS (SELECT order_id, revenue * revenue * revenue / 1e9 AS cube, quantity FROM sales)"
_CAPS = _CUBE + """
    , q AS (SELECT quantile_cont(cube, 0.25) AS a, quantile_cont(cube, 0.75) AS b FROM t)
    , w AS (SELECT a - 3 * (b - a) AS lo, b + 3 * (b - a) AS hi FROM q)
    , k AS (SELECT count(*) AS n, count(*) FILTER (WHERE cube < lo OR cube > hi) AS x FROM t, w)"""


def _cubes(spark, sf) -> DataFrame:
    r = F.col("revenue")
    # written once: bounds, counts and the result each read it
    return staged_table(Tables(spark, sf).sales.select("order_id", (r * r * r / 1e9).alias("cube"), "quantity"))


@query("cln3_cap_outliers", sql("sales", _CAPS + """
    SELECT order_id, quantity, round(CASE WHEN x > 0 AND x <= greatest(10, floor(n * 0.02e0))
                                     THEN least(greatest(cube, lo), hi) ELSE cube END, 2) AS cube FROM t, w, k"""))
def cln3(spark, sf):
    capped, _ = C.cap_outliers(_cubes(spark, sf))
    return capped.select("order_id", "quantity", F.round("cube", 2).alias("cube"))


@query("cln4_remove_outliers", sql("sales", _CAPS + """
    SELECT order_id, quantity, round(cube, 2) AS cube FROM t, w, k
    WHERE NOT (x > 0 AND x / n::DOUBLE <= 0.05e0 AND (cube < lo OR cube > hi))"""))
def cln4(spark, sf):
    kept, _ = C.remove_outliers(_cubes(spark, sf))
    return kept.select("order_id", "quantity", F.round("cube", 2).alias("cube"))


_TYPED = """
    , u AS (SELECT DISTINCT order_id, line_no, try_strptime(ship_date, '%Y-%m-%d') AS ship_date, trim(category) AS category,
                   try_cast(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price, quantity, flag, note FROM dirty)"""
_FILLED = f"""
    SELECT order_id, line_no, strftime(coalesce(ship_date, {_MODE.format(c='ship_date', v='u')}), '%Y-%m-%d') AS ship_date,
           category, price, coalesce(quantity, (SELECT median(quantity) FROM u)) AS quantity,
           coalesce(flag, {_MODE.format(c='flag', v='u')}) AS flag, coalesce(note, 'Unknown') AS note FROM u"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("order_id").cast("long").alias("order_id"), F.col("line_no").cast("long").alias("line_no"),
        F.date_format("ship_date", "yyyy-MM-dd").alias("ship_date"), "category", "price", "quantity", "flag", "note",
    )


@query("cln5_clean_dataset", sql("dirty", _TYPED + _FILLED))
def cln5(spark, sf):
    return _shown(C.clean_dataset(Tables(spark, sf).dirty)[0])


@query("cln5_report", sql("dirty", _DUP + """
    , f AS (SELECT count(*) AS rows, (3 * count(*) - count(quantity) - count(flag) - count(note)) AS m FROM dirty)
    , u AS (SELECT DISTINCT * FROM dirty)
    , a AS (SELECT count(*) AS n, 3 * count(*) - count(quantity) - count(flag) - count(note)
                   + count(*) FILTER (WHERE ship_date = 'n/a') AS m FROM u)
    SELECT rows AS rows_before, n AS rows_after, rows - n AS duplicates_removed, a.m AS missing_filled, 5::BIGINT AS text_trimmed,
           1::BIGINT AS numeric_converted, 1::BIGINT AS dates_converted, 0::BIGINT AS outliers_detected,
           0::BIGINT AS outliers_capped,
           round(100 - (f.m / (rows * 8e0) * 45 + (SELECT sum(n - 1) FROM g) / rows::DOUBLE * 35 + 1 / 8e0 * 20), 2) AS quality_before,
           100e0 AS quality_after FROM f, a"""))
def cln5b(spark, sf):
    return C.clean_dataset(Tables(spark, sf).dirty)[1]


@query("cln6_clean_for_download", sql("dirty", _TYPED.replace("replace(replace(price, '$', ''), ',', '')", "replace(price, ',', '')")
       .replace("try_cast(replace(price, ',', '') AS DOUBLE)", "price") + _FILLED))
def cln6(spark, sf):
    return _shown(C.clean_for_download(Tables(spark, sf).dirty)[0])
