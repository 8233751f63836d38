"""Profiles: what a table holds, column by column, in long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import (
    INTEGRAL_TYPES, NUMERIC_TYPES, TIME_TYPES, clamp, col, numeric_columns, percent, text_columns, total_of,
)
from tallyforge.functions.text import contains_any, numeric_from_text
from tallyforge.operators import backbone as B


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def missing_by_column(df: DataFrame, digits: int = 1) -> DataFrame:
    return B.missing_stats(df).select(
        "column", F.col("missing").alias("missing_count"),
        percent(F.col("missing"), F.col("rows"), digits).alias("missing_percent"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    return B.row_missing_stats(df).select(
        "missing_cells", "missing_rows", "missing_columns",
        percent(F.col("missing_cells"), F.col("rows") * F.col("columns"), 4).alias("missing_percentage"),
    )


def duplicate_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    return B.duplicate_stats(df).select(
        "duplicate_rows", percent(F.col("duplicate_rows"), F.col("rows"), digits).alias("duplicate_percent")
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    names = ["mean", "std", "min", "q1", "median", "q3", "max"]
    return B.numeric_summary(df, columns).select(
        "column", F.col("n").alias("count"), *[F.round(n, digits).alias(n) for n in names]
    )


def numeric_kpis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Totals and spread of every numeric column that is not an identifier."""
    columns = columns or [c for c in numeric_columns(df) if not is_id_name(c)]
    shown = ["total", "mean", "median", "min", "max", "std", "variance"]
    return B.numeric_summary(df, columns).select(
        "column", *[F.round(n, 2).alias(n) for n in shown],
        (F.col("rows") - F.col("n")).alias("missing_count"), F.col("n").alias("non_null_count"),
    )


def distribution(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    columns = (columns or numeric_columns(df))[:limit]
    found = B.numeric_summary(df, columns).where("n > 0")
    return found.select(
        "column", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
        F.coalesce(F.round("std", 4), F.lit(0.0)).alias("std"), F.round("q1", 4).alias("p25"),
        F.round("q3", 4).alias("p75"), F.coalesce(F.round("skew", 4), F.lit(0.0)).alias("skew"),
    )


def category_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    found = B.frequency_summary(df, columns or text_columns(df))
    return found.select(
        "column", "top_value", percent(F.col("top_records"), F.col("non_null"), 1).alias("top_share"), "unique_count"
    )


def categorical_kpis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    found = B.frequency_summary(df, columns or text_columns(df))
    return found.select(
        "column", F.col("top_value").alias("top_category"), F.col("top_records").alias("top_category_count"),
        percent(F.col("top_records"), F.col("non_null"), 4).alias("top_category_percentage"),
        "unique_count", F.col("non_null").alias("non_null_count"),
    )


def cardinality(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    found = B.distinct_counts(df, columns, approximate)
    return found.select(
        "column", "unique_count",
        F.round(F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("cardinality_ratio"),
    )


def is_id_name(name: str) -> bool:
    n = name.lower()
    return n.endswith("id") or "_id" in n or n.startswith("id_")


def _physical(df: DataFrame) -> Column:
    """Map literal column -> physical class, looked up per profile row."""
    pairs = []
    for f in df.schema:
        kind = (
            "datetime" if isinstance(f.dataType, TIME_TYPES)
            else "boolean" if isinstance(f.dataType, T.BooleanType)
            else "integer" if isinstance(f.dataType, INTEGRAL_TYPES)
            else "float" if isinstance(f.dataType, NUMERIC_TYPES)
            else "text"
        )
        pairs += [F.lit(f.name), F.lit(kind)]
    return F.create_map(*pairs)[F.col("column")]


def semantic_type(name: Column, physical: Column, unique: Column, rows: Column) -> Column:
    """Column type for display, from name, physical class and distinct count."""
    n = F.lower(name)
    numeric = physical.isin("integer", "float")
    identifier = (n == "id") | n.endswith("_id") | n.endswith(" id") | (unique / F.greatest(rows, F.lit(1)) > 0.9)
    return (
        F.when(physical == "datetime", "datetime")
        .when(numeric & identifier, "id")
        .when(numeric & contains_any(n, L.PERCENT_HINTS), "percentage")
        .when(numeric & contains_any(n, L.CURRENCY_HINTS), "currency")
        .when(numeric, "numeric")
        .when(contains_any(n, L.TIME_HINTS), "datetime_candidate")
        .when(contains_any(n, L.LOCATION_HINTS), "location")
        .when(unique <= F.least(F.lit(50.0), rows * 0.5), "categorical")
        .otherwise("text")
    )


def analytic_type(name: Column, physical: Column, unique: Column, rows: Column) -> Column:
    """Column type that decides how a column is aggregated."""
    n = F.translate(F.lower(name), "_", " ")
    numeric = physical.isin("integer", "float")
    out = (
        F.when(physical == "datetime", "datetime")
        .when(physical == "boolean", "boolean")
        .when(numeric & n.endswith("id"), "identifier")
    )
    for kind, hints in L.MEASURE_HINTS.items():
        out = out.when(numeric & contains_any(n, hints), kind)
    return (
        out.when(numeric, "measure")
        .when(contains_any(n, ["date", "time", "month", "year"]), "datetime_candidate")
        .when(unique <= F.least(F.lit(50.0), F.greatest(F.lit(2.0), rows * 0.4)), "dimension")
        .otherwise("text")
    )


def infer_semantic_schema(df: DataFrame) -> DataFrame:
    found = B.distinct_counts(df).withColumn("physical", _physical(df))
    missing = F.col("rows") - F.col("non_null")
    return found.select(
        "column", semantic_type(F.col("column"), F.col("physical"), F.col("unique_count"), F.col("rows"))
        .alias("semantic_type"),
        F.col("non_null").alias("non_null_count"), missing.alias("missing_count"),
        percent(missing, F.col("rows"), 2).alias("missing_percent"), "unique_count",
    )


def inspect_dataset(df: DataFrame) -> DataFrame:
    """Analytic type, completeness and, for measures, the basic statistics of every column."""
    base = B.distinct_counts(df).withColumn("physical", _physical(df))
    kind = analytic_type(F.col("column"), F.col("physical"), F.col("unique_count"), F.col("rows"))
    numbers = [c for c in numeric_columns(df) if not B.identifier_name(c)]  # of identifiers no statistics are shown
    typed = base.withColumn("analytic_type", kind)
    stats = ["total", "mean", "median", "min", "max", "std"]
    if numbers:
        typed = typed.join(F.broadcast(B.numeric_summary(df, numbers).select("column", *stats)), "column", "left")
    else:
        typed = typed.select("*", *[F.lit(None).cast("double").alias(s) for s in stats])
    measure = F.col("physical").isin("integer", "float") & (F.col("analytic_type") != "identifier")
    whole = F.greatest(F.col("rows"), F.lit(1))
    return typed.select(
        "column", "analytic_type",
        F.when(measure, "numeric").when(F.col("analytic_type").isin("dimension", "text"), "categorical")
        .when(F.col("analytic_type") == "datetime", "datetime").otherwise("other").alias("column_group"),
        (F.col("rows") - F.col("non_null")).alias("missing_count"), "unique_count",
        F.round(F.col("unique_count") / whole, 4).alias("cardinality_ratio"),
        F.round(F.col("non_null") / whole, 4).alias("completeness"),
        *[F.when(measure, F.round(s, 4)).alias(s) for s in stats],
    )


def column_flags(df: DataFrame) -> DataFrame:
    """Eight yes/no facts per column."""
    found = B.distinct_counts(df).withColumn("physical", _physical(df))
    n = F.lower(F.col("column"))
    numeric = F.col("physical").isin("integer", "float")
    return found.select(
        "column",
        (n.endswith("id") | F.contains(n, F.lit("_id")) | n.startswith("id_")).alias("is_id"),
        (F.col("physical") == "datetime").alias("is_date"),
        (F.col("physical") == "boolean").alias("is_boolean"),
        numeric.alias("is_numeric"),
        (F.col("physical") == "integer").alias("is_integer"),
        (F.col("physical") == "float").alias("is_float"),
        (~numeric & (F.col("unique_count") < F.greatest(F.lit(50.0), F.col("rows") * 0.5))).alias("is_categorical"),
        ((F.col("physical") == "text") & (F.col("non_null") > 0)).alias("is_text"),
        F.col("non_null").alias("non_null_count"), "unique_count",
    )


def map_semantic_columns(schema: DataFrame) -> DataFrame:
    """semantic_type -> sorted column names; input is one row per column."""
    return schema.groupBy("semantic_type").agg(F.array_sort(F.collect_list("column")).alias("columns"))


def validation_report(df: DataFrame, repeated_names: list[str] = ()) -> DataFrame:
    """(severity, type, column, message) of every data problem found."""
    spark = df.sparkSession
    facts = B.row_missing_stats(df)
    missing = facts.where("missing_cells > 0").select(
        F.lit("medium").alias("severity"), F.lit("missing_values").alias("type"), F.lit(None).cast("string").alias("column"),
        F.format_string("%d cells are missing.", F.col("missing_cells")).alias("message"),
    )
    repeats = B.duplicate_stats(df).where("duplicate_rows > 0").select(
        F.lit("medium").alias("severity"), F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"),
        F.format_string("%d duplicate rows detected.", F.col("duplicate_rows")).alias("message"),
    )
    empty = B.missing_stats(df).where("non_null = 0").select(
        F.lit("high").alias("severity"), F.lit("empty_column").alias("type"), "column",
        F.concat("column", F.lit(" is completely empty.")).alias("message"),
    )
    out = missing.unionByName(repeats).unionByName(empty)
    if repeated_names:
        names = spark.createDataFrame([(n,) for n in repeated_names], "column string").select(
            F.lit("high").alias("severity"), F.lit("duplicate_column").alias("type"), "column",
            F.concat("column", F.lit(" appeared more than once and was renamed.")).alias("message"),
        )
        out = out.unionByName(names)
    return out


def iqr_bounds(
    df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, by: list[str] = ()
) -> DataFrame:
    """(by..., column, n, q1, q3, lower, upper); columns with fewer than 4 values or IQR 0 are left out."""
    iqr = F.col("q3") - F.col("q1")
    return (
        B.quartiles(df, columns, by)
        .where((F.col("n") >= 4) & (iqr != 0))
        .withColumn("lower", F.col("q1") - F.lit(factor) * iqr)
        .withColumn("upper", F.col("q3") + F.lit(factor) * iqr)
    )


def bounds_as_row(bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds of all columns as one row ``lower_<i>``, ``upper_<i>`` (NULL where a column has none)."""
    picks = []
    for i, c in enumerate(columns):
        here = F.col("column") == c
        picks += [F.max(F.when(here, F.col("lower"))).alias(f"lower_{i}"),
                  F.max(F.when(here, F.col("upper"))).alias(f"upper_{i}")]
    return bounds.agg(*picks)


def with_bounds(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Attach the one-row bounds to every row through scalar subqueries (no join, no collect)."""
    row = bounds_as_row(bounds, columns)
    packed = row.select(F.struct(*row.columns).alias("b")).scalar()
    return df.withColumn("_b", packed)


def outside(columns: list[str]) -> list[Column]:
    """Per column: is the value outside its bounds (needs ``with_bounds``)."""
    return [
        F.coalesce(
            (col(c) < F.col(f"_b.lower_{i}")) | (col(c) > F.col(f"_b.upper_{i}")), F.lit(False)
        )
        for i, c in enumerate(columns)
    ]


def outlier_counts(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """(column, lower_bound, upper_bound, outliers) in one further scan."""
    columns = columns or numeric_columns(df)
    bounds = iqr_bounds(df, columns, factor)
    marks = outside(columns)
    counted = with_bounds(df, bounds, columns).agg(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.count_if(m).alias("outliers")) for c, m in zip(columns, marks)
        ]).alias("s")
    ).select(F.inline("s"))
    return bounds.join(F.broadcast(counted), "column").select(
        "column", F.round("lower", 4).alias("lower_bound"), F.round("upper", 4).alias("upper_bound"), "outliers"
    )


def _health_inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of everything the health scores need: STATS, duplicates and outlier rows."""
    marks = outside(columns)
    outliers = B.fact(df, ("outlier rows", *columns), lambda: with_bounds(df, iqr_bounds(df, columns), columns).agg(
        F.count_if(total_of([m.cast("int") for m in marks]) > 0).alias("outlier_rows")
    ))
    facts = B.row_missing_stats(df)
    return facts.select(
        "*",
        B.duplicate_stats(df).select("duplicate_rows").scalar().alias("duplicate_rows"),
        outliers.scalar().alias("outlier_rows"),
    )


def _invalid_rate(df: DataFrame, threshold: float = 0.8) -> Column:
    """Cells that fail to be a number, over all cells of columns meant as numbers: typed ones and texts that mostly parse."""
    texts = text_columns(df)
    if not texts:
        return F.lit(0.0)
    if B.known(df):  # each distinct text is parsed once
        parsed = F.coalesce(F.sum(F.when(numeric_from_text(F.col("value")).isNotNull(), F.col("records"))), F.lit(0))
        each = B.frequency(df, texts).groupBy("column").agg(F.sum("records").cast("double").alias("n"), parsed.cast("double").alias("k"))
        counts = B.fact(df, "parsed texts", lambda: each.agg(F.collect_list(F.struct("n", "k")).alias("s")).withColumn("rows", shape(df).select("rows").scalar()))
    else:
        filled = [F.count(col(c)).cast("double") for c in texts]
        parsed = [F.count(numeric_from_text(col(c))).cast("double") for c in texts]
        counts = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.struct(n.alias("n"), k.alias("k")) for n, k in zip(filled, parsed)]).alias("s"))
    mostly = F.filter("s", lambda x: (x["n"] > 0) & (x["k"] >= threshold * x["n"]))
    bad = F.aggregate(mostly, F.lit(0.0), lambda a, x: a + x["n"] - x["k"])
    cells = F.col("rows") * F.greatest(F.lit(1), F.size(mostly) + F.lit(len(numeric_columns(df))))
    return F.coalesce(counts.select((bad / F.greatest(cells, F.lit(1))).alias("r")).scalar(), F.lit(0.0))


def health_score_weighted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Score from missing, duplicate, invalid and outlier-row rates; weights .4 .3 .2 .1."""
    columns = columns or [c for c in numeric_columns(df) if not is_id_name(c)]
    rows = F.greatest(F.col("rows"), F.lit(1)).cast("double")
    rates = _health_inputs(df, columns).select(
        (F.col("missing_cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1))).alias("missing_penalty"),
        (F.col("duplicate_rows") / rows).alias("duplicate_penalty"),
        _invalid_rate(df).alias("invalid_penalty"),
        (F.col("outlier_rows") / rows).alias("outlier_penalty"),
    )
    penalty = (
        F.col("missing_penalty") * 0.4 + F.col("duplicate_penalty") * 0.3
        + F.col("invalid_penalty") * 0.2 + F.col("outlier_penalty") * 0.1
    )
    return rates.select(
        *[F.round(c, 6).alias(c) for c in rates.columns],
        clamp(F.round((F.lit(1.0) - penalty) * 100, 4), 0.0, 100.0).alias("health_score"),
    )


def dataset_health(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: missing, duplicate and outlier percent and the overall health score."""
    columns = columns or numeric_columns(df)
    rates = _health_inputs(df, columns).select(
        percent(F.col("missing_cells"), F.col("rows") * F.col("columns"), 2).alias("missing_percent"),
        percent(F.col("duplicate_rows"), F.col("rows"), 2).alias("duplicate_percent"),
        percent(F.col("outlier_rows"), F.col("rows"), 2).alias("outlier_percent"),
    )
    score = (
        F.lit(100.0) - F.col("missing_percent") * 0.45 - F.col("duplicate_percent") * 0.35
        - F.col("outlier_percent") * 0.2
    )
    return rates.withColumn("overall_health_score", F.round(F.greatest(F.lit(0.0), score), 2))


def column_quality(df: DataFrame) -> DataFrame:
    """(column, missing_percent, quality_score)."""
    missing = percent(F.col("missing"), F.col("rows"), 2)
    return B.missing_stats(df).select(
        "column", missing.alias("missing_percent"), F.round(F.greatest(F.lit(0.0), 100 - missing), 2).alias("quality_score")
    )


def quality_score(df: DataFrame) -> DataFrame:
    """100 less 45 x missing, 35 x duplicate and 20 x empty-column rate."""
    facts = B.row_missing_stats(df).select(
        "*", B.duplicate_stats(df).select("duplicate_rows").scalar().alias("duplicate_rows")
    )
    rows = F.greatest(F.col("rows"), F.lit(1)).cast("double")
    penalty = (
        F.col("missing_cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)) * 45
        + F.col("duplicate_rows") / rows * 35
        + F.col("empty_columns") / F.greatest(F.col("columns"), F.lit(1)) * 20
    )
    score = F.when(F.col("rows") == 0, 0.0).otherwise(F.round(clamp(F.lit(100.0) - penalty, 0.0, 100.0), 2))
    return facts.select("rows", "missing_cells", "duplicate_rows", "empty_columns", score.alias("quality_score"))


def null_matrix(df: DataFrame) -> DataFrame:
    """Rows per null pattern, a 0/1 digit per column in column order."""
    pattern = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(pattern.alias("null_pattern")).agg(F.count(F.lit(1)).alias("rows"))


def executive_health(missing: Column, duplicates: Column, anomalies: Column) -> tuple[Column, Column]:
    """(score, label) of the executive view."""
    score = clamp(
        F.floor(F.lit(100) - missing - duplicates - F.least(anomalies, F.lit(5)) * 3).cast("double"), 35, 95
    ).cast("long")
    label = F.when(score >= 80, "Strong").when(score >= 60, "Watchlist").otherwise("At Risk")
    return score, label


def display_health(missing_sum: Column, duplicate_percent: Column) -> Column:
    """The dashboard's score: at least 20."""
    return F.greatest(
        F.lit(20.0), F.round(F.lit(100.0) - F.least(F.lit(80.0), missing_sum + duplicate_percent))
    ).cast("long")


def missing_hotspots(df: DataFrame, k: int = 3) -> DataFrame:
    return missing_by_column(df).orderBy(F.desc("missing_percent"), F.asc("column")).limit(k)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and duplicates removed, missing percent before and after."""
    def facts(df: DataFrame) -> DataFrame:
        return B.row_missing_stats(df).select(
            "rows", percent(F.col("missing_cells"), F.col("rows") * F.col("columns"), 4).alias("missing"),
            B.duplicate_stats(df).select("duplicate_rows").scalar().alias("duplicates"),
        )

    b, a = facts(before), facts(after)
    packed = a.select(F.struct("rows", "missing", "duplicates").alias("a")).scalar()
    return b.withColumn("a", packed).select(
        (F.col("rows") - F.col("a.rows")).alias("rows_removed"),
        (F.col("duplicates") - F.col("a.duplicates")).alias("duplicates_removed"),
        F.col("missing").alias("missing_before"), F.col("a.missing").alias("missing_after"),
        F.round(F.col("a.missing") - F.col("missing"), 4).alias("missing_improvement"),
    )
