"""Tables, derived views (in Spark and in SQL) and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.functions.text import humanize
from tallyforge.session import scratch_folder
from tallyforge.sources.readers import read_table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def half_up(text: str) -> str:
    """Make every ``round`` of an oracle round the decimal value half up, as Spark does.

    DuckDB rounds the binary value of a double, so 0.145 would become 0.14 there
    and 0.15 in Spark; a cast to DECIMAL first gives both the same rule.
    """
    out, at = [], 0
    for found in re.finditer(r"\bround\(", text):
        if found.start() < at:
            continue
        depth, comma, i = 1, None, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if text[i] == "," and depth == 1:
                comma = i
            i += 1
        value = text[found.end():comma if comma else i - 1]
        digits = text[comma + 1:i - 1].strip() if comma else "0"
        out += [text[at:found.start()], f"round(({half_up(value)})::DECIMAL(38,12), {digits})::DOUBLE"]
        at = i
    return "".join(out) + text[at:]


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""
    def add(fn):
        REGISTRY[name] = (fn, half_up(sql) if sql else None)
        return fn
    return add


class Tables:
    """Lazy access to the driver tables and the derived views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def sales(self) -> DataFrame:
        """One row per order line with customer, product and region. Join sides are chosen by size at run time."""
        price = F.col("l_extendedprice")
        return (
            self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"),
                F.col("c_name").alias("customer_name"), F.col("p_name").alias("product_name"),
                F.col("p_type").alias("category"), F.col("r_name").alias("region"),
                F.col("l_quantity").alias("quantity"), (price * (1 - F.col("l_discount"))).alias("revenue"),
                F.col("l_discount").alias("discount"), (price * 0.6).alias("cost"),
            )
        )

    @property
    def holed(self) -> DataFrame:
        """Sales with holes by key: some quantities, discounts and regions are NULL."""
        k = F.col("order_id")
        return self.sales.select(
            "order_id", "order_date",
            F.when(k % 7 != 0, F.col("region")).alias("region"), "category",
            F.when(k % 10 != 0, F.col("quantity")).alias("quantity"), "revenue",
            F.when(k % 4 != 0, F.col("discount")).alias("discount"),
        )

    @property
    def dirty(self) -> DataFrame:
        """Order lines as damaged text: currency, blanks, holes, repeats, an empty column, bad dates."""
        key = F.col("l_orderkey")
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            key.alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
            F.when(key % 20 == 0, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("ship_date"),
            F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")).alias("category"),
            F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"),
            F.when(key % 10 != 0, F.col("l_quantity")).alias("quantity"),
            F.when(key % 3 != 0, F.col("l_returnflag")).alias("flag"),
            F.lit(None).cast("string").alias("note"),
        )
        return lines.unionAll(lines.where(F.col("order_id") % 50 == 0))

    @property
    def user_features(self) -> DataFrame:
        """Per user: number, sum, mean and maximum of event values."""
        return self.events.groupBy("user_id").agg(
            F.count(F.lit(1)).cast("double").alias("events"), F.sum("value").alias("total"),
            F.avg("value").alias("mean"), F.max("value").alias("top"),
        )

    @property
    def supplier_lines(self) -> DataFrame:
        """Order lines as many small data sets, one per supplier."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("dataset_id"), F.col("l_shipdate").alias("ship_date"),
            F.col("p_brand").alias("brand"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.col("l_quantity").alias("quantity"),
        ).withColumn("tail", F.pow(F.col("revenue") * F.col("revenue") / 1e6, F.lit(2.0)) / 1e3)


# Each view by name: (names of views it reads, SQL).
VIEWS: dict[str, tuple[list[str], str]] = {
    "sales": ([], """
        SELECT o_orderkey AS order_id, o_orderdate::TIMESTAMP AS order_date, c_name AS customer_name,
               p_name AS product_name, p_type AS category, r_name AS region, l_quantity AS quantity,
               l_extendedprice * (1 - l_discount) AS revenue, l_discount AS discount, l_extendedprice * 0.6e0 AS cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "holed": (["sales"], """
        SELECT order_id, order_date, CASE WHEN order_id % 7 <> 0 THEN region END AS region, category,
               CASE WHEN order_id % 10 <> 0 THEN quantity END AS quantity, revenue,
               CASE WHEN order_id % 4 <> 0 THEN discount END AS discount FROM sales"""),
    "dirty0": ([], """
        SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line_no,
               CASE WHEN l_orderkey % 20 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS ship_date,
               '  ' || p_type || ' ' AS category, '$' || format('{:,.2f}', l_extendedprice) AS price,
               CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS quantity,
               CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS flag, NULL::VARCHAR AS note
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "dirty": (["dirty0"], "SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE order_id % 50 = 0"),
    "user_features": ([], """
        SELECT user_id, count(*)::DOUBLE AS events, sum(value) AS total, avg(value) AS mean, max(value) AS top
        FROM events GROUP BY user_id"""),
    "supplier_lines": ([], """
        SELECT l_suppkey AS dataset_id, l_shipdate::TIMESTAMP AS ship_date, p_brand AS brand,
               l_extendedprice * (1 - l_discount) AS revenue, l_quantity AS quantity,
               pow((l_extendedprice * (1 - l_discount)) * (l_extendedprice * (1 - l_discount)) / 1e6, 2) / 1e3 AS tail
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
}


def sql(views: str, body: str) -> str:
    """The oracle text: ``WITH`` the named views (and what they read), then the body.

    A body may begin with ``, name AS (...)`` to add its own steps.
    """
    done: dict[str, str] = {}

    def need(name: str) -> None:
        before, text = VIEWS[name]
        for b in before:
            need(b)
        done.setdefault(name, text)

    for v in views.split():
        need(v)
    head = ", ".join(f"{n} AS ({t})" for n, t in done.items())
    body = body.strip()
    if not head:
        return ("WITH " + body[1:]) if body.startswith(",") else body
    return f"WITH {head}{body if body.startswith(',') else ' ' + body}"


__all__ = ["REGISTRY", "Tables", "VIEWS", "humanize", "query", "scratch_folder", "sql"]
