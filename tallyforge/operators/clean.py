"""Cleaning: table in, repaired table out, with a report of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.functions.lookups import DATE_NAME_HINTS
from tallyforge.functions.semantics import TIME_TYPES, any_of, col, numeric_columns, text_columns
from tallyforge.functions.text import CURRENCY_MARKS
from tallyforge.operators import backbone as B, normalize as N, profile as P
from tallyforge.session import staged_table


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of identical rows; repeats are combined before the shuffle."""
    return df.dropDuplicates()


def _written(df: DataFrame) -> DataFrame:
    """``df`` written once by columns; a column without a type stays one."""
    table = staged_table(df)
    return table.withColumns({c: F.lit(None) for c, kind in df.dtypes if kind == "void"})


def fill_values(df: DataFrame) -> dict:
    """Column -> fill value: median of numbers, smallest mode of the rest.

    Collects one row per column.
    """
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    out: dict = {}
    if numbers:
        found = {r["column"]: r["median"] for r in B.quartiles(df, numbers).select("column", "median").collect()}
        out.update({c: found.get(c, 0.0) for c in numbers})
    if others:
        modes = {r["column"]: r["top_value"] for r in B.frequency_summary(df, others).collect()}
        for f in df.schema:
            if f.name in others:
                empty = "1970-01-01 00:00:00" if isinstance(f.dataType, TIME_TYPES) else "Unknown"
                out[f.name] = modes.get(f.name, empty)
    return out


def fill_missing(df: DataFrame, values: dict | None = None) -> DataFrame:
    """Replace NULLs by the fill values, in one projection."""
    values = fill_values(df) if values is None else values
    out = []
    for f in df.schema:
        if f.name not in values:
            out.append(col(f.name))
            continue
        fill = F.lit(values[f.name])
        kind = f.dataType
        if f.name in numeric_columns(df):
            # A median may be fractional, so a filled whole-number column becomes double.
            out.append(F.coalesce(col(f.name).cast("double"), fill.cast("double")).alias(f.name))
        elif isinstance(kind, (T.StringType, *TIME_TYPES, T.BooleanType)):
            out.append(F.coalesce(col(f.name), fill.cast(kind)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def _outlier_plan(df: DataFrame, factor: float) -> tuple[list[dict], int]:
    """Bounds, outlier count and row count of every numeric column without 'id' in its name."""
    columns = [c for c in numeric_columns(df) if "id" not in c.lower()]
    if not columns:
        return [], df.count()
    bounds = {r["column"]: r for r in P.iqr_bounds(df, columns, factor).collect()}
    columns = [c for c in columns if c in bounds]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if((col(c) < bounds[c]["lower"]) | (col(c) > bounds[c]["upper"])).alias(f"n{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    plan = [
        {"column": c, "lower": bounds[c]["lower"], "upper": bounds[c]["upper"], "count": counts[f"n{i}"]}
        for i, c in enumerate(columns)
    ]
    return plan, counts["rows"]


def cap_outliers(df: DataFrame, factor: float = 3.0) -> tuple[DataFrame, dict]:
    """Clip a column to its bounds when at most max(10, 2 % of rows) values lie outside."""
    plan, rows = _outlier_plan(df, factor)
    clip = {p["column"]: p for p in plan if 0 < p["count"] <= max(10, int(rows * 0.02))}
    out = []
    for c in df.columns:
        p = clip.get(c)
        if p is None:
            out.append(col(c))
        else:
            v = col(c).cast("double")
            out.append(F.when(v < p["lower"], p["lower"]).when(v > p["upper"], p["upper"]).otherwise(v).alias(c))
    report = {
        "outliers_detected": sum(p["count"] for p in plan),
        "outliers_capped": sum(p["count"] for p in clip.values()),
    }
    return df.select(*out), report


def remove_outliers(df: DataFrame, factor: float = 3.0) -> tuple[DataFrame, dict]:
    """Drop rows outside the bounds of any column with an outlier rate of at most 5 %."""
    plan, rows = _outlier_plan(df, factor)
    used = [p for p in plan if 0 < p["count"] / max(rows, 1) <= 0.05]
    flagged = any_of([
        F.coalesce((col(p["column"]) < p["lower"]) | (col(p["column"]) > p["upper"]), F.lit(False)) for p in used
    ])
    return df.where(~flagged), {"outlier_columns": [p["column"] for p in used]}


def _facts(df: DataFrame) -> dict:
    return P.quality_score(df).first().asDict()


def clean_dataset(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names, text, numbers, dates, duplicates, missing values, outliers - in that order.

    Returns the cleaned frame and a one-row report. The de-duplicated frame is
    read by many jobs, so it is written once, by columns.
    """
    spark = df.sparkSession
    before = _facts(df)
    work = N.trim_strings(N.snake_columns(df))
    texts = text_columns(work)
    ratios = N.parse_ratios(work).collect() if texts else []
    types = N.decide_types(ratios, 0.8, 0.6, DATE_NAME_HINTS)
    work = _written(drop_duplicates(N.apply_types(work, types)))
    missing = P.missing_summary(work).first()["missing_cells"]
    filled = fill_missing(work)
    capped, outliers = cap_outliers(filled)
    after = _facts(capped)
    report = {
        "rows_before": before["rows"], "rows_after": after["rows"],
        "duplicates_removed": before["rows"] - after["rows"],
        "missing_filled": missing - after["missing_cells"],
        "text_trimmed": len(texts),
        "numeric_converted": sum(k == "numeric" for k in types.values()),
        "dates_converted": sum(k == "datetime" for k in types.values()),
        **outliers,
        "quality_before": before["quality_score"], "quality_after": after["quality_score"],
    }
    return capped, spark.createDataFrame([report], _schema(report))


def clean_for_download(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The download variant: types by content, then duplicates, outlier rows, missing values."""
    spark = df.sparkSession
    before = _facts(df)
    work = N.trim_strings(N.snake_columns(df))
    texts = text_columns(work)
    ratios = N.parse_ratios(work, ",₹").collect() if texts else []
    types = N.decide_types(ratios, 0.8, 0.8)
    work = _written(drop_duplicates(N.apply_types(work, types, ",₹")))
    kept, _ = remove_outliers(work)
    filled = fill_missing(kept)
    rows_unique = work.count()
    after = _facts(filled)
    report = {
        "rows_before": before["rows"], "rows_after": after["rows"],
        "duplicates_removed": before["duplicate_rows"],
        "outliers_removed": rows_unique - after["rows"],
        "missing_values_before": before["missing_cells"], "missing_values_after": after["missing_cells"],
        "missing_values_filled": max(0, before["missing_cells"] - after["missing_cells"]),
        "text_columns_trimmed": len(texts),
        "numeric_columns_converted": sum(k == "numeric" for k in types.values()),
        "date_columns_standardized": sum(k == "datetime" for k in types.values()),
    }
    return filled, spark.createDataFrame([report], _schema(report))


def _schema(report: dict) -> T.StructType:
    kinds = {int: T.LongType(), float: T.DoubleType()}
    return T.StructType([T.StructField(k, kinds[type(v)]) for k, v in report.items()])
