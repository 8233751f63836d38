"""Language of text columns: detection, purity rule, localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.semantics import col
from tallyforge.functions.text import contains_any, replace_terms

_WORDS = "([\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+)"


def has_devanagari(text: Column) -> Column:
    return text.rlike(L.DEVANAGARI)


def normalize_language(code: Column) -> Column:
    return F.when(code.isin("en", "hi", "hinglish"), code).otherwise("en")


def detect_language(text: Column, hint: Column | None = None) -> Column:
    """Speech locale of a text: the hint, a language name in it, its script, then typical words."""
    lower = F.lower(text)
    hint = F.lit(None).cast("string") if hint is None else hint
    return (
        F.when(hint == "en", "en-US").when(hint.isin("hi", "hinglish"), "hi-IN")
        .when(contains_any(lower, ["english", "angrezi"]), "en-US")
        .when(contains_any(lower, ["hindi", "हिंदी", "hinglish"]), "hi-IN")
        .when(has_devanagari(text), "hi-IN")
        .when(contains_any(lower, L.HINGLISH_MARKERS), "hi-IN")
        .otherwise(F.coalesce(hint, F.lit("en-US")))
    )


def response_style(text: Column, locale: Column, hint: Column | None = None) -> Column:
    """english, hindi or hinglish."""
    lower = F.lower(text)
    hint = F.lit(None).cast("string") if hint is None else hint
    return (
        F.when(hint == "en", "english").when(hint == "hi", "hindi").when(hint == "hinglish", "hinglish")
        .when(F.contains(lower, F.lit("hinglish")), "hinglish")
        .when(contains_any(lower, ["hindi", "हिंदी"]) | has_devanagari(text), "hindi")
        .when(locale.startswith("hi"), "hinglish").otherwise("english")
    )


def english_ratio(text: Column) -> Column:
    """Share of the words that are English and not on the allow-list."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), 1)
    english = F.filter(words, lambda w: w.rlike("[A-Za-z]") & ~F.lower(w).isin(L.ALLOWED_ENGLISH_IN_HINDI))
    return F.coalesce(F.try_divide(F.size(english).cast("double"), F.size(words)), F.lit(0.0))


def purity_problem(text: Column, language: Column) -> Column:
    """NULL for a pure text, else the reason."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    code = normalize_language(language)
    return (
        F.when(blank, None)
        .when((code == "en") & has_devanagari(text), "English output contains Hindi Unicode characters.")
        .when((code == "hi") & (english_ratio(text) > 0.05), "Hindi output contains too much English text.")
        .when((code == "hinglish") & has_devanagari(text), "Hinglish output contains Devanagari characters.")
    )


def purity_violations(df: DataFrame, keys: list[str], fields: list[str], language: Column) -> DataFrame:
    """(keys..., path, reason) of every text field that breaks the rule."""
    tagged = df.withColumn("_language", language)
    long = tagged.select(*[col(k) for k in keys], "_language", *[col(f) for f in fields]).unpivot(
        [*keys, "_language"], fields, "path", "text"
    )
    found = long.withColumn("reason", purity_problem(F.col("text"), F.col("_language")))
    return found.where("reason IS NOT NULL").select(*keys, "path", "reason")


def localize_text(text: Column, language: str) -> Column:
    """Display phrases, then word patterns, in table order; all inside one projection."""
    out = F.translate(text, "_", " ")
    out = replace_terms(out, L.DISPLAY_PHRASES.get(language, []))
    for pattern, target in L.WORD_PATTERNS.get(language, []):
        out = F.regexp_replace(out, pattern, target)
    return out


def normalize_question(text: Column) -> Column:
    """Hindi and Hinglish business words of a question in English."""
    return replace_terms(F.trim(F.lower(text)), L.QUESTION_TERMS)


def normalize_spoken(text: Column) -> Column:
    """The assistant's wider vocabulary; blanks are collapsed."""
    padded = F.concat(F.lit(" "), F.trim(F.lower(text)), F.lit(" "))
    return F.trim(F.regexp_replace(replace_terms(padded, L.ASSISTANT_TERMS), r"\s+", " "))
