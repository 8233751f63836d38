"""Text expressions: labels, value formats, parsing of dirty numbers and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters dropped before a text value is read as a number.
CURRENCY_MARKS = ",$₹%"

# Date layouts tried in order, with the shape of text each one can read; an
# ambiguous day/month is read month first. The shape is tested first because a failed parse is slow.
DATE_LAYOUTS = [
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", r"^\d{4}-\d{2}-\d{2} \d"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", r"^\d{4}-\d{2}-\d{2}T"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("dd MMM yyyy", r"^\d{2} [A-Za-z]{3} \d{4}$"),
    ("MMM dd, yyyy", r"^[A-Za-z]{3} \d{2}, \d{4}$"),
    ("yyyy-MM", r"^\d{4}-\d{2}$"),
]


def humanize(value: Column) -> Column:
    """``order_date`` -> ``Order Date``."""
    return F.initcap(F.trim(F.translate(value, "_", " ")))


def humanize_name(name: str) -> str:
    """The same label for a column name known on the driver."""
    return " ".join(w[:1].upper() + w[1:].lower() for w in str(name or "").replace("_", " ").strip().split(" "))


def humanize_acronyms(value: Column) -> Column:
    """Title-cased label that keeps ID, KPI and CSV in capitals."""
    label = F.initcap(F.lower(F.regexp_replace(F.trim(F.translate(value, "_", " ")), r"\s+", " ")))
    for word in ("Id", "Kpi", "Csv"):
        label = F.regexp_replace(label, rf"\b{word}\b", word.upper())
    return label


def format_value(value: Column) -> Column:
    """100 000 and more in lakh, smaller values with thousands separators."""
    return F.when(F.abs(value) >= 100000, F.format_string("%.2f lakh", value / F.lit(100000.0))).otherwise(
        F.format_number(value, 2)
    )


def numeric_from_text(value: Column, marks: str = CURRENCY_MARKS) -> Column:
    """A double read from currency or percent text; NULL when it is not a number."""
    return F.trim(F.translate(value, marks, "")).try_cast("double")


def timestamp_from_text(value: Column) -> Column:
    """A timestamp by the first layout that fits; NULL when none does."""
    text = F.trim(value)
    tried = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))) for layout, shape in DATE_LAYOUTS]
    return F.when(text.rlike(r"\d"), F.coalesce(*tried))


def contains_any(value: Column, words: list[str]) -> Column:
    """True when any word occurs in the value; one JVM regex, no per-word scan."""
    return value.rlike("|".join(re.escape(w) for w in words))


def replace_terms(value: Column, terms: list[tuple[str, str]]) -> Column:
    """Literal replacements applied in list order."""
    for source, target in terms:
        value = F.replace(value, F.lit(source), F.lit(target))
    return value


def first_sentence(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(value, ".", 1), r"[()]", ""))


def slug(value: Column) -> Column:
    """Lower-cased words separated by single blanks."""
    return F.lower(F.trim(F.regexp_replace(value, r"[^A-Za-z0-9_]+", " ")))
