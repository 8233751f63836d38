"""Periodic runs of words, found online by a sparse dynamic program over diagonals.

A diagonal is a lag q; its match length at a word is the number of words in a row that equal the word q places before. Going
through a document once, the earlier occurrences of each word lengthen the diagonals of their lags; a diagonal that is
not lengthened has ended, and if its stretch is long enough for its period it is emitted there and then.

Which earlier occurrences are looked at is what makes it sparse. In a stretch of smallest period q and at least 4 q words, the
nearest earlier copy of any L >= q words is q words before (a nearer one would give a smaller period). So for each L = 1, 2, 4, ..
only the nearest earlier copy of the L words that end at a word counts, and only if its lag lies in (L / 2, L]. Every run has such
words on one diagonal, without a gap from the place where the first L words match to its last word; a stretch of a
smaller period never shows up under a larger lag. That is at most log n occurrences of a word, few in ordinary text, and
nothing is cut off: copies of 2 L words are named by the names of their halves, exactly, and only where both halves repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallyforge.llm.rolling import release
from tallyforge.llm.shared import fresh_name

POWER, LEAST = 4, 6


def word_ids(words: list[bytes]) -> np.ndarray:
    """A whole number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def occurrences(ids: np.ndarray, power: int = POWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(L, words, lags) for L = 1, 2, 4, ..: words at which L words end whose nearest earlier copy lies L / 2 < lag <= L before."""
    n, level, at, names = len(ids), 1, np.arange(len(ids)), ids
    while len(at) and power * (level // 2 + 1) <= n:
        order = np.argsort(names, kind="stable")
        place, name = at[order], names[order]
        same = name[1:] == name[:-1]
        here, lag = place[1:][same], (place[1:] - place[:-1])[same]
        fit = (lag <= level) & (2 * lag > level)
        if fit.any():
            yield level, here[fit], lag[fit]
        # the next names: pairs of names that end at a word and ``level`` words before, where both occur again
        often = np.zeros(len(place), bool)
        often[1:] = same
        often[:-1] |= same
        group = np.cumsum(np.append(True, ~same)) - 1
        name_at = np.full(n, -1, np.int64)
        name_at[place[often]] = group[often]
        ends = np.flatnonzero(name_at >= 0)
        ends = ends[ends >= level]
        ends = ends[name_at[ends - level] >= 0]
        at, names, level = ends, name_at[ends - level] * n + name_at[ends], 2 * level


def runs_of(ids: np.ndarray, power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, power * period) words, by start and period.

    A run is a stretch with that smallest period that no neighbouring word extends; ``power`` is at least 4.
    """
    found = list(occurrences(ids, power))
    if not found:
        return []
    at = np.concatenate([x[1] for x in found])
    lags = np.concatenate([x[2] for x in found])
    first = np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in found])
    order = np.lexsort((lags, at))
    matches: dict[int, int] = {}  # active diagonals: words in a row that equal the word ``lag`` before
    latest: dict[int, int] = {}  # the word at which a diagonal was lengthened last
    out: list[tuple[int, int, int]] = []

    def ended(lag: int) -> None:
        length = matches.pop(lag) + lag
        last = latest.pop(lag)
        if length >= max(least, power * lag):
            out.append((last + 1 - length, length, lag))

    now = -1
    for word, lag, grown in zip(at[order].tolist(), lags[order].tolist(), first[order].tolist(), strict=True):
        if word != now:
            for old in [q for q, seen in latest.items() if seen < word - 1]:
                ended(old)
            now = word
        matches[lag] = matches[lag] + 1 if lag in matches else grown
        latest[lag] = word
    for old in list(matches):
        ended(old)
    return sorted((s, n, q) for s, n, q in out)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    out = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        out[start + period] += 1
        out[start + length] -= 1
    keep = np.cumsum(out[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find_runs(docs: DataFrame, power: int = POWER, least: int = LEAST, name: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with the columns n_words, runs (array of start, length, period) and collapsed (text).

    Words are runs of anything but ASCII white space in the whole text; start is the number of a word, from 0. Null and empty texts
    have no words, no runs and an empty collapsed text. Every row stands for itself, so repeated rows and ids get equal results and
    an empty table none. A column of ``docs`` with one of the three names is replaced. A document is one unit of work; memory
    is bounded by the longest one.
    """
    if power < 4 or least < 1:
        raise ValueError("runs need at least four periods")
    out, own = fresh_name("runs", docs), fresh_name("words_of", docs)
    kept = [c for c in (columns or docs.columns) if c.lower() not in ("n_words", "runs", "collapsed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(name).cast("string").alias(own))
    schema = docs.drop(own).schema.add(out, StructType.fromDDL("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(struct)), ("collapsed", pa.string())])

    def scan(batches):
        for batch in batches:
            counts, spans, texts = [], [], []
            for text in batch.column(own):
                words = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                words = words.split()  # of bytes: splits at ASCII white space alone
                runs = runs_of(word_ids(words), power, least) if len(words) >= least else []
                counts.append(len(words))
                spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapsed(words, runs).decode("utf-8"))
            made = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(struct)), pa.array(texts, pa.string())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([own]).columns, made], [*kept, out])
        release()

    return docs.mapInArrow(scan, schema).select(*[F.col(f"`{c}`") for c in kept], f"{out}.*")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; none: nulls) and the digests of all runs and of the kept words."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"), "")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("CAST(1000 * b.length div -b.p AS bigint)").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_periods(docs: DataFrame, share: int = 10) -> DataFrame:
    """doc_id and text of every row; in one of ``share`` documents (by crc32 of the id) all words from some place on repeat a period.

    With h the crc32 of the decimal id and g = h / 10: of n words, those from a = g % n on become a period of 1 + (n - a) / (3 + g % 8) words
    (whole divisions). Rows of null id or text are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", h)
    hit = F.coalesce((F.col("h") % share == 0), F.lit(False)) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    made = made.withColumn("w", F.when(hit, words)).withColumn("g", F.expr(f"h div {share}")).withColumn("n", F.size("w").cast("long"))
    made = made.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.expr("slice(w, cast(a + 1 as int), cast(p as int))")
    times = F.expr("cast((n - a + p - 1) div p as int)")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.expr("cast(n - a as int)"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return made.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(text).alias("text"))
