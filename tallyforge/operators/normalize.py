"""Names, types and values of a freshly read table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.functions.semantics import col, text_columns
from tallyforge.functions.text import CURRENCY_MARKS, numeric_from_text, timestamp_from_text


def sanitize_names(names: list[str]) -> tuple[list[str], list[str]]:
    """Trimmed names without repeats, and the names that were repeated."""
    seen: dict[str, int] = {}
    out, repeated = [], []
    for raw in names:
        name = re.sub(r"\s+", " ", str(raw).strip() or "column")
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
        if seen[name] > 1:
            repeated.append(name)
    return out, repeated


def snake_names(names: list[str]) -> list[str]:
    """Lower-case names of letters, digits and single underscores, without repeats."""
    taken: set[str] = set()
    out = []
    for raw in names:
        base = "_".join(re.findall(r"[0-9a-z]+", str(raw).lower())) or "column"
        name, suffix = base, 2
        while name in taken:
            name, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(name)
        out.append(name)
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns)[0])


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def trim_strings(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[F.trim(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, timestamps to ISO text."""
    out = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def empty_columns(df: DataFrame) -> DataFrame:
    """(column) of the columns without any value."""
    from tallyforge.operators.backbone import missing_stats

    return missing_stats(df).where("non_null = 0").select("column")


def parse_ratios(df: DataFrame, marks: str = CURRENCY_MARKS) -> DataFrame:
    """(column, rows, non_null, numeric, dates): how many values of each text column parse, in one scan."""
    texts = text_columns(df)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(col(c)).alias("non_null"),
            F.count(numeric_from_text(col(c), marks)).alias("numeric"),
            F.count(timestamp_from_text(col(c))).alias("dates"),
        )
        for c in texts
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array(*stats).alias("s")).select("rows", F.inline("s"))


def decide_types(
    ratios: list, numeric_share: float, date_share: float, date_hints: list[str] | None = None
) -> dict[str, str]:
    """Column -> 'numeric' or 'datetime' from the collected parse ratios (one row per text column)."""
    out = {}
    for r in ratios:
        hinted = date_hints is None or any(h in r["column"].lower() for h in date_hints)
        if r["non_null"] and r["numeric"] / r["non_null"] >= numeric_share:
            out[r["column"]] = "numeric"
        elif r["non_null"] and hinted and r["dates"] / max(r["rows"], 1) >= date_share:
            out[r["column"]] = "datetime"
    return out


def apply_types(df: DataFrame, types: dict[str, str], marks: str = CURRENCY_MARKS) -> DataFrame:
    """Rewrite the decided columns in one projection."""
    out = []
    for c in df.columns:
        kind = types.get(c)
        if kind == "numeric":
            out.append(numeric_from_text(col(c), marks).alias(c))
        elif kind == "datetime":
            out.append(timestamp_from_text(col(c)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def normalize(df: DataFrame, numeric_share: float = 0.85, date_share: float = 0.85) -> tuple[DataFrame, dict]:
    """Sanitised names, trimmed text and inferred types; the report names what changed.

    One job (the parse ratios, one row per text column); everything else is lazy.
    """
    names, repeated = sanitize_names(df.columns)
    renamed = dict(zip(df.columns, names))
    df = trim_strings(df.toDF(*names))
    ratios = parse_ratios(df).collect() if text_columns(df) else []
    types = decide_types(ratios, numeric_share, date_share)
    report = {
        "renamed_columns": renamed,
        "duplicate_columns": repeated,
        "empty_columns": [r["column"] for r in ratios if r["non_null"] == 0],
        "numeric_columns_converted": [c for c, k in types.items() if k == "numeric"],
        "datetime_columns_converted": [c for c, k in types.items() if k == "datetime"],
    }
    return apply_types(df, types), report
