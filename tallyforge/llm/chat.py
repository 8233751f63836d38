"""Chat formatting with typed content parts, in DataFrame functions alone.

``format_conversations`` takes one row per turn with ``parts``, an array of (type, text, ref, amount). The parts of a turn are visited in
order: text is escaped and kept; an image, audio or document part becomes the next numbered placeholder of its conversation,
its reference is recorded, and ``amount`` (tiles, seconds, pages; null counts as one) is expanded to tokens. The template is

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Inside texts and roles every ``<`` + n backslashes + ``|`` gets one backslash more, so no control string can appear there and the step can be
undone; line ends and backslashes of roles are escaped too. Positions are code points. ``read_back`` recovers the turns from
``formatted`` alone and the trained text from the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens per unit of ``amount`` of each kind of attachment.
TOKENS = {"image": 256.0, "audio": 25.0, "document": 1024.0}
PARTS = "array<struct<type: string, text: string, ref: string, amount: double>>"


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part (null: empty), for tables that hold plain texts."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS), F.lit(False))


def _visit(part: Column) -> Column:
    """What a part writes before escaping: its text, or a marked place for an attachment of its kind.

    A NUL of a text is followed by a letter of its own, so that only attachments write NUL + ``a``; ``_settle`` takes both back.
    """
    plain = F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\0"), F.lit("\0t"))
    return F.when(_attached(part), F.concat(F.lit("\0a"), part["type"], F.lit(";"))).otherwise(plain)


def _settle(body: Column, before: Column) -> Column:
    """Places become numbered placeholders, counted on from ``before``."""
    def placed(piece: Column, k: Column) -> Column:
        kind = F.substring_index(piece, ";", 1)
        rest = piece.substr(F.length(kind) + 2, F.length(piece))
        return F.when(k == 0, piece).otherwise(F.concat(F.lit("<|"), kind, F.lit("_"), (before + k).cast("string"), F.lit("|>"), rest))

    return F.replace(F.array_join(F.transform(F.split(body, "\\x00a", -1), placed), ""), F.lit("\0t"), F.lit("\0"))


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, mask, attachments.

    ``turns``: conv_id, turn, role, parts (type ``PARTS``). ``mask`` is an array of (start, length) of the contents of ``trained`` turns; ``attachments``
    an array of (kind, number, ref, turn, tokens) in order of appearance. Turns are ordered by turn (null first), then
    by role and parts, so ties and repeated rows have one order; all are kept. A null conv_id is one conversation. Null roles,
    parts and texts are empty; a part of unknown type is visited as text. An empty table gives no rows. Numbers and positions are prefix sums
    over the turns, so the work is linear in turns and parts. The text of one conversation must fit into one value (2 GB).
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("i", (F.row_number().over(order) - 1).cast("int")).withColumn("own", F.size(F.filter("parts", _attached))).withColumn(
        "before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    tokens = F.create_map(*[F.lit(x) for kind in TOKENS.items() for x in kind])
    listed = F.transform(F.filter("parts", _attached), lambda a, k: F.struct(
        a["type"].alias("kind"), (F.col("before") + k + 1).cast("int").alias("number"), a["ref"].alias("ref"), F.col("i").alias("turn"),
        F.ceil(F.coalesce(a["amount"], F.lit(1.0)) * tokens[a["type"]]).cast("long").alias("tokens")))
    # neighbouring texts are joined before they are escaped: a control string may be spread over them
    tail = f"{END}\n"
    written = numbered.select(
        "conv_id", "i", "role", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        _settle(escape(F.array_join(F.transform("parts", _visit), "")), F.col("before")).alias("body"), listed.alias("listed"))
    placed = written.withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(tail)).over(
        W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    turn = F.struct("i", F.concat("head", "body", F.lit(tail)).alias("text"), (F.col("role") == trained).alias("own"), F.struct(
        F.col("start").cast("int").alias("start"), F.length("body").alias("length")).alias("span"), "listed")
    talks = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return talks.select(
        "conv_id", F.array_join(F.col("turns.text"), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"),
        F.transform(F.filter("turns", lambda t: t["own"]), lambda t: t["span"]).alias("mask"), F.flatten(F.col("turns.listed")).alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), trained (the unescaped text under the mask) and formatted_chars, from ``formatted`` and ``mask``.

    The text is split at its control strings, positions are prefix sums over the pieces, and each span of the mask is read from the piece
    whose content begins where the span does. Placeholders of attachments come back as they stand in the text.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    kind = "struct<i: int, piece: string, start: int, length: int>"
    none = F.lit(None)
    items = F.concat(F.transform(pieces, lambda p, i: F.struct(i, p, none, none).cast(kind)),
                     F.transform("mask", lambda m: F.struct(none, none, m["start"], m["length"]).cast(kind)))
    # computed ahead of the inline, which would carry the whole text beside every piece
    packed = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), items.alias("items"))
    rows = packed.select("conv_id", "formatted_chars", F.inline("items")).withColumn(
        "head", F.substring_index("piece", "\n", 1))
    skipped = len(START) * (F.col("i") + 1) + F.coalesce(F.sum(F.length("piece")).over(
        W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("start", F.coalesce("start", skipped + F.length("head") + 1)).withColumn(
        "length", F.max("length").over(W.partitionBy("conv_id", "start")))
    body = F.length("head") + 2
    text = F.col("piece").substr(body, F.length("piece") - body + 1 - (len(END) + 1))
    told = F.struct("i", _unescape_role(F.col("head")).alias("role"), unescape(text).alias("text"), F.coalesce(
        unescape(F.col("piece").substr(body, F.col("length"))), F.lit("")).alias("trained"))
    turns = placed.where("i IS NOT NULL").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(told)).alias("told"), F.max("formatted_chars").alias("formatted_chars"))
    return turns.select("conv_id", F.transform("told", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
                        F.array_join(F.col("told.trained"), "").alias("trained"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")
