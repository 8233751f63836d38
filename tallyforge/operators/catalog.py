"""Meaning of columns and tables, over a catalog of many data sets.

The catalog has one row per column: dataset_id, column_name, position, data_type
('number', 'text' or 'time'). Keyword tables are literals in the expression, so
nothing is joined and every result is one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import total_of
from tallyforge.functions.text import contains_any


def _plain(name: Column) -> Column:
    return F.translate(F.lower(name), "_", " ")


def role_array(name: Column, whole_word: bool = False) -> Column:
    """Roles whose keywords occur in a column name (optionally as whole words)."""
    n = _plain(name)

    def hit(words: list[str]) -> Column:
        return n.rlike(r"\b(" + "|".join(words) + r")\b") if whole_word else contains_any(n, words)

    return F.array_compact(F.array(*[F.when(hit(w), role) for role, w in L.ROLE_KEYWORDS.items()]))


def find_roles(catalog: DataFrame, whole_word: bool = False) -> DataFrame:
    """(dataset_id, column_name, role)."""
    return catalog.select(
        "dataset_id", "column_name", F.explode(role_array(F.col("column_name"), whole_word)).alias("role")
    )


def choose_columns(catalog: DataFrame) -> DataFrame:
    """(dataset_id, measure, dimension, time): the best column of each kind by role priority, then position."""
    n = _plain(F.col("column_name"))

    def best(kind: str, roles: list[str]) -> Column:
        rank = F.coalesce(*[F.when(contains_any(n, L.ROLE_KEYWORDS[r]), i) for i, r in enumerate(roles)], F.lit(len(roles)))
        key = F.struct(rank.alias("r"), F.col("position"), F.col("column_name").alias("c"))
        return F.min(F.when(F.col("data_type") == kind, key))["c"]

    timed = F.struct(F.lit(0).alias("r"), F.col("position"), F.col("column_name").alias("c"))
    named = F.struct(F.lit(1).alias("r"), F.col("position"), F.col("column_name").alias("c"))
    hinted = contains_any(F.lower("column_name"), ["date", "time", "created", "timestamp", "order_date"])
    when = F.min(F.when(F.col("data_type") == "time", timed).when(hinted, named))["c"]
    return catalog.groupBy("dataset_id").agg(
        best("number", L.MEASURE_PRIORITY).alias("measure"), best("text", L.DIMENSION_PRIORITY).alias("dimension"),
        when.alias("time"),
    )


def _hits(n: Column, words: list[str]) -> Column:
    return total_of([F.contains(n, F.lit(w)).cast("double") for w in words])


def _pick(scores: DataFrame, domains: list[str], fallback: float) -> DataFrame:
    """Normalised scores, the best domain (first of the list on ties) and its share."""
    total = total_of([F.col(d) for d in domains])
    shares = scores.withColumn("_t", total).select(
        "dataset_id", "_t", *[F.round(F.try_divide(F.col(d), F.col("_t")), 4).alias(d) for d in domains]
    )
    best = F.greatest(*[F.col(d) for d in domains])
    name = F.coalesce(*[F.when(F.col(d) == best, d) for d in domains])
    found = F.col("_t") > 0
    return shares.select(
        "dataset_id", F.when(found, name).otherwise("generic").alias("domain"),
        F.when(found, best).otherwise(fallback).alias("confidence"),
        F.create_map(*[x for d in domains for x in (F.lit(d), F.coalesce(F.col(d), F.lit(0.0)))]).alias("scores"),
    )


def classify_domain(catalog: DataFrame) -> DataFrame:
    """(dataset_id, domain, confidence, scores) by keyword hits with small boosts by column types."""
    n = _plain(F.col("column_name"))
    counted = catalog.groupBy("dataset_id").agg(
        *[F.sum(_hits(n, words)).alias(d) for d, words in L.DOMAIN_KEYWORDS.items()],
        (F.bool_or(F.col("data_type") == "number") & F.bool_or(F.col("data_type") == "time")).alias("_series"),
        F.bool_or(contains_any(n, ["patient", "claim"])).alias("_care"),
        F.bool_or(contains_any(n, ["employee", "salary"])).alias("_staff"),
    )
    boost = {d: F.when(F.col("_series"), 0.25).otherwise(0.0) for d in ("sales", "finance", "logistics", "marketing")}
    boost["healthcare"] = F.when(F.col("_care"), 0.75).otherwise(0.0)
    boost["hr"] = F.when(F.col("_staff"), 0.75).otherwise(0.0)
    domains = list(L.DOMAIN_KEYWORDS)
    scores = counted.select("dataset_id", *[(F.col(d) + boost.get(d, F.lit(0.0))).alias(d) for d in domains])
    return _pick(scores, domains, 0.35)


def infer_domain(catalog: DataFrame) -> DataFrame:
    """The same with the second vocabulary, ten domains and other boosts."""
    n = _plain(F.col("column_name"))
    counted = catalog.groupBy("dataset_id").agg(
        *[F.sum(_hits(n, words)).alias(d) for d, words in L.INDUSTRY_KEYWORDS.items()],
        (F.bool_or(contains_any(n, ["date", "time"])) & F.bool_or(F.col("data_type") == "number")).alias("_dated"),
        ((F.count_if(F.col("data_type") == "text") >= 2) & F.bool_or(contains_any(n, ["product", "category", "sku"]))).alias("_goods"),
        F.bool_or(contains_any(n, ["amount", "balance", "transaction"])).alias("_money"),
    )

    def flag(name: str, points: float) -> Column:
        return F.when(F.col(name), points).otherwise(0.0)

    boost = {
        "sales": flag("_dated", 0.5), "operations": flag("_dated", 0.25), "retail": flag("_goods", 0.75),
        "ecommerce": flag("_goods", 0.5), "finance": flag("_money", 0.4), "banking": flag("_money", 0.4),
    }
    domains = list(L.INDUSTRY_KEYWORDS)
    scores = counted.select("dataset_id", *[(F.col(d) + boost.get(d, F.lit(0.0))).alias(d) for d in domains])
    return _pick(scores, domains, 1.0)


def catalog_of(df: DataFrame, dataset_id: str) -> DataFrame:
    """The catalog rows of one table."""
    from tallyforge.functions.semantics import numeric_columns, time_columns

    numbers, times = numeric_columns(df), time_columns(df)
    rows = [
        (dataset_id, c, i, "number" if c in numbers else "time" if c in times else "text") for i, c in enumerate(df.columns)
    ]
    return df.sparkSession.createDataFrame(rows, "dataset_id string, column_name string, position int, data_type string")
