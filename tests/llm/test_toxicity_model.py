"""The character model, the decoder and the length curve of the toxicity score against brute force."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallyforge.llm import toxicity
from tallyforge.llm.rolling import text_buffer

TEXTS = ["you idiot and you moron", "The stupid CLOWN has lost 12 keys.", "", None, "über die straße", "a", "idiot idiot loser", "la niña es boba"]


def expected_grams(texts):
    total = Counter()
    for t in texts:
        raw = (t or "").encode()
        low = b"   " + bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in raw) + b"   "
        if t:
            total.update(low[k:k + 4] for k in range(len(low) - 3))
    return total


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.character_model(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))


def test_grams_equal_brute_force_on_any_partitioning(spark, model):
    want = expected_grams(TEXTS)
    got = {int(k).to_bytes(4, "big"): int(n) for k, n in zip(model.keys, np.diff(model.before), strict=True)}
    assert {g: n for g, n in got.items() if g.strip()} == {g: n for g, n in want.items() if g.strip()}
    for size in (1, 2, 3):
        parts = Counter()
        for g, n in got.items():
            parts[g[:size]] += n
        assert all(model.count(g) == n for g, n in parts.items())
        assert model.count(b"zzz"[:size]) == 0
    spread = toxicity.character_model(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(5))
    assert (spread.keys == model.keys).all() and (spread.before == model.before).all()


def path_score(decoder, pieces):
    score, where = sum(cost for _, cost in pieces), b" "
    for b in "".join(text for text, _ in pieces).encode():
        one = b" " if bytes([b]).isdigit() else bytes([b])
        score += decoder.step(where, one)
        where = (where + one)[-3:]
    return score + decoder.step(where, b" ")


@settings(max_examples=60, deadline=None)
@given(st.text("1lo03ei@s5tmrn*ñа", min_size=1, max_size=7))
def test_viterbi_finds_the_best_of_all_paths(model, observed):
    decoder = toxicity.Decoder(model)
    paths = {}
    for path in itertools.product(*decoder.choices(observed)):
        text = "".join(t for t, _ in path)
        paths[text] = max(paths.get(text, -np.inf), path_score(decoder, path))
    assert paths[decoder.decode(observed)] == pytest.approx(max(paths.values()), abs=1e-9)


def test_chance_evidence_of_long_texts_does_not_mark_them():
    """Weak stems that every long text meets by chance; marked texts hold many of them, or one strong word."""
    rng = np.random.default_rng(7)
    stems = [f"stem{k:03d}" for k in range(20)]

    def text(n, weak, strong=False):
        w = [f"{''.join(rng.choice(list('abcdefgh'), 6))}" for _ in range(n)] + [f"{rng.choice(stems)}x{int(rng.integers(10_000))}y" for _ in range(weak)]
        return " ".join([*rng.permutation(w), *(["dreadful"] if strong else [])])

    texts = [text(60, 10) for _ in range(60)] + [text(80, 0, True) for _ in range(60)] + [text(80, 0) for _ in range(900)] + [text(3000, 6) for _ in range(30)]
    y = np.array([1] * 120 + [0] * 930)

    def rows(many):
        buf, offsets = text_buffer(pa.array(many))
        doc, hashes = toxicity.word_features(buf, offsets)
        at = np.searchsorted(doc, np.arange(len(many) + 1))
        return [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    fitted = toxicity.train(rows(texts), y, np.ones(len(y)))
    fresh = [text(60, 10) for _ in range(20)] + [text(80, 0, True) for _ in range(20)] + [text(80, 0) for _ in range(20)] + [text(3000, 6) for _ in range(20)] + ["", None]
    buf, offsets = text_buffer(pa.array(fresh))
    got = fitted.probability(fitted.evidence(*toxicity.word_features(buf, offsets), len(fresh)))
    assert ((got >= 0.5) == np.array([True] * 40 + [False] * 42)).all(), np.round(got, 2)


def test_curve_keeps_its_signs():
    """Longer marked texts and weaker evidence of marked texts must not turn the curve round."""
    total, words = np.array([1.0, 2, 3, 4, 5, 6]), np.array([900.0, 800, 700, 6, 5, 4])
    curve = toxicity.length_curve(toxicity.curve_inputs(total, total, words), np.array([1.0, 1, 1, 0, 0, 0]), np.ones(6))
    assert curve[0] >= 0 and curve[1] >= 0 and curve[2] <= 0
    none = toxicity.train([], np.zeros(0, int), np.zeros(0))
    assert none.probability(none.evidence(np.zeros(0, np.int64), np.zeros((0, 5), np.uint64), 2)).tolist() == [0.5, 0.5]
