"""Periodic runs, ranked search, packing and text encoding against brute force, the tokenizers library and a reading of whole results."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import curve_packing, encoder, periodic, ranked_search
from tallyforge.llm.queries import ORACLES, PACK_END_ID, QUERIES, tokenizer_path

SPACE, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SMALL = "/root/testdata/sf0.001"


def all_runs(w):
    """Every maximal stretch of every period, the smallest period of a stretch alone."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(words):
    runs = all_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 2), max_size=10))
def test_runs_equal_brute_force(head, period, times, tail):
    words = head + period * times + period[:len(period) // 2] + tail
    assert periodic.runs_of(np.array(words, np.int64)) == all_runs(words)


def test_long_repeats_take_a_moment():
    ids = np.zeros(1_000_000, np.int64)
    assert periodic.runs_of(ids) == [(0, 1_000_000, 1)]
    ids = np.tile(np.arange(1000), 1000)
    assert periodic.runs_of(ids) == [(0, 1_000_000, 1000)]


def test_runs_of_odd_rows(spark):
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n"), (None, "x x x x x x"), (5, "x x x x x"), (6, "é é " * 7), (7, "A a " * 3),
            (8, " ".join(f"w{k}" for k in range(2000)) + " z" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("runs", "collapsed", "n_words", "start", "w", "h")})
    found = periodic.find_runs(docs)
    assert {"start", "w", "h"} < set(found.columns)
    got = sorted(tuple(r) for r in periodic.digest(found.drop("start")).collect() if r.doc_id is not None)
    assert got == sorted((i, *run_row(SPACE.findall(t or ""))) for i, t in rows if i is not None)
    assert {r.doc_id: r.collapsed for r in found.collect()}[1] == "a b c" and found.where("doc_id IS NULL").first().collapsed == "x"
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query_of_runs_equals_brute_force(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, text in texts:
        w, h = SPACE.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if len(text or "") > 20_000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want[i] = run_row(w)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(texts) and {i: got[i] for i in want} == want and sum(r[0] > 0 for r in want.values()) > 5


def ranking(docs, items, k):
    """The contract of ranked search, term by term in whole numbers."""
    said = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        asked, scored = Counter(TERM.findall(text.translate(LOWER))), []
        for i, c in said:
            m = 25 + 75 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"t{int(k)}" for k in range(120)]
    texts = [" ".join(vocabulary[int(min(119, k))] for k in rng.zipf(1.3, int(rng.integers(1, 80)))) for _ in range(300)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(900 - k, texts[5]) for k in range(14)] + [(1000, None), (1001, ""), (1002, "... --"), (None, texts[5]), (1003, "common " * 40_000), (7, texts[7]), (1004, "ÉTÉ été T3 t3")]
    items = [(k, " ".join(texts[k].split()[:25])) for k in range(20)] + [(20, texts[5]), (20, texts[5]), (20, "T3 été"), (21, None), (22, ""), (23, "unseen words"), (None, "t9 t9 t50")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item", "score", "rank", "n", "terms", "block")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "term")})
    for block in (ranked_search.BLOCK, 60):
        got = sorted((tuple(r) for r in ranked_search.search(table, bench, block=block).collect()), key=str)
        assert got == ranking(docs, items, 10)
    assert ranked_search.search(table.limit(0), bench).count() == 0 and ranked_search.search(table, bench.limit(0)).count() == 0


def test_accumulators_stop_and_lose_nothing():
    """After the stop only documents with an accumulator are updated, and the best k are those of a full run."""
    rng = np.random.default_rng(9)
    rows = [{"doc_id": k, "n": 40, "terms": np.unique(np.append(rng.integers(0, 4, 3), [4 + k % 40])).astype("<u4")} for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows]), pa.array([r["n"] for r in rows]), pa.array([r["terms"].tobytes() for r in rows], pa.binary()),
                                        pa.array([np.ones(len(r["terms"]), "<u4").tobytes() for r in rows], pa.binary())], ["doc_id", "n", "terms", "counts"])
    df = np.bincount(np.concatenate([r["terms"] for r in rows]), minlength=44)
    shard = ranked_search.Shard([batch], 400, 16_000, ranked_search.weights(400, df))
    terms = np.array([9, 0, 1])
    full = np.zeros(400, np.int64)
    for t in terms:
        a, b = shard.bounds[t], shard.bounds[t + 1]
        full[shard.doc[a:b]] += shard.part[a:b]
    doc, score = shard.best(terms, np.ones(3, np.int64), 10, 0)
    order = np.lexsort((doc, -score))[:10]
    assert doc[order].tolist() == np.lexsort((np.arange(400), -full))[:10].tolist() and np.array_equal(score, full[doc])
    assert len(doc) < 400 and set(doc.tolist()) <= set(shard.doc[shard.bounds[9]:shard.bounds[10]].tolist())


def test_query_of_search_equals_its_sql(spark):
    from oracle import compare, connect

    assert compare(spark, connect(SMALL), "op12", QUERIES["op12_ranked_search"], ORACLES["op12_ranked_search"], SMALL) is None


def test_hilbert_keys_are_a_curve():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = curve_packing.hilbert_key(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def packed(pieces):
    """Checks that pieces are gapless in documents and sequences; ids by row of the input are returned as a sorted list."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at < 64 and at & (at - 1) == 0
    return by_doc


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"word{int(x)}" for x in rng.integers(0, 50, int(rng.integers(0, 60))))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "long " * 5000), (None, "no id"), (503, "İ ΣΑΣ <|endoftext|> \x1c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("place", "ids", "start", "length")}).repartition(4)
    pieces = curve_packing.pack(docs, tokenizer_path(), PACK_END_ID, 64).collect()
    by_doc = packed(pieces)
    for i, text in rows:
        want = [*own.encode(text or "", add_special_tokens=False).ids, PACK_END_ID]
        at, got = 0, []
        for start, ids, total in sorted(by_doc[i]):
            assert start == at and total == len(want)
            at += len(ids)
            got += ids
        assert got == want
    made = curve_packing.sequences(spark.createDataFrame(pieces, curve_packing._KIND), 64).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in made) and sum(r.n_tokens for r in made) == sum(r.length for r in pieces)
    twice = curve_packing.pack(docs.unionByName(docs), tokenizer_path(), PACK_END_ID, 64).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in pieces)
    again = curve_packing.pack(docs, tokenizer_path(), PACK_END_ID, 64).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))
    assert curve_packing.pack(docs.limit(0), tokenizer_path(), PACK_END_ID).count() == 0
    with pytest.raises(ValueError):
        curve_packing.pack(docs, tokenizer_path(), PACK_END_ID, 100)


def test_similar_documents_lie_side_by_side(spark):
    rng = np.random.default_rng(6)
    topics = [[f"{name}{k}" for k in range(30)] for name in ("alpha", "river", "copper", "window")]
    rows = [(k, " ".join(rng.choice(topics[k % 4], 120))) for k in range(200)]
    placed = curve_packing.encoded(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), PACK_END_ID).orderBy("place").collect()
    order = [r.doc_id % 4 for r in placed]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.85 * len(order)


def test_query_of_packing(spark):
    rows = QUERIES["op13_curve_packing"](spark, SMALL).collect()
    total, sizes = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
        sizes[r.sequence_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)
    assert len(total) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abzAZ09'’\".,-_#éÉßÿƀ×÷ªº²½ \t\n  …–€İΣσςё́\x1c\x00<|>", max_size=40), max_size=12))
def test_encoder_equals_the_library(texts):
    own = encoder.encoder_of(tokenizer_path())
    assert own.merges is not None
    ids, bounds = own.encode(pa.array([*texts, None], pa.string()))
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_other_tokenizers_go_through_the_library():
    own = encoder.TextEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["Some  text, here\n", "", "é x"]
    ids, bounds = own.encode(pa.array(texts))
    assert own.merges is None and [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
