"""The chat query against its SQL, hashlib and a plain loop; long conversations, NUL texts and many parts."""

from __future__ import annotations

import hashlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tallyforge.llm import chat
from tallyforge.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_llm_query_equals_oracle(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) is None


def test_chat_digests_of_a_long_conversation(spark):
    n = 30000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    text = F.concat(F.lit("<\\|é\0a;<|"), F.col("id").cast("string"), F.lit("|>\U0001d11e"))
    turns = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    made = chat.format_conversations(turns.repartition(5).withColumn("parts", chat.text_parts(F.col("text"))))
    got = chat.digest(made).first()
    rows = [("user" if i % 3 == 0 else "assistant", f"<\\|é\0a;<|{i}|>\U0001d11e") for i in range(n)]
    own = "".join(t for r, t in rows if r == "assistant")
    assert (got.n_turns, got.loss_chars) == (n, len(own))
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    whole = "".join(f"<|im_start|>{r}\n" + t.replace("<\\|", "<\\\\|").replace("<|", "<\\|") + "<|im_end|>\n" for r, t in rows)
    row = made.first()
    assert row.formatted == whole and got.formatted_chars == len(whole)
    spans = "".join(row.formatted[m.start:m.start + m.length] for m in row["mask"])
    assert spans.replace("<\\|", "<|").replace("<\\|", "<|") and len(row["mask"]) == n - n // 3


def test_chat_turn_of_many_parts(spark):
    kinds = "IF(i % 2 = 0, struct('audio', CAST(NULL AS string), 'r', 2D), struct('text', concat('\\0', i), CAST(NULL AS string), CAST(NULL AS double)))"
    turns = spark.sql(f"SELECT t AS conv_id, 0L AS turn, 'user' AS role, transform(sequence(1, 20000), i -> {kinds}) AS parts FROM VALUES (1L), (2L) v(t)")
    for row in chat.format_conversations(turns).collect():
        body = "".join(f"<|audio_{i // 2}|>" if i % 2 == 0 else f"\0{i}" for i in range(1, 20001))
        assert row.formatted == f"<|im_start|>user\n{body}<|im_end|>\n"
        assert [a.number for a in row.attachments] == list(range(1, 10001)) and row.attachments[0].tokens == 50
