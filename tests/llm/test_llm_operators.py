"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, host_suffix, license_scan, mixing, nbsvm, ngram_join, rp_forest, token_store, toxicity, winnow
from tallyforge.llm.components import components
from tallyforge.llm.queries import END_ID, tokenizer_path
from tallyforge.llm.shared import one_row_each, without_ids

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, short, empty, null and one long text; a repeated row; a shared passage."""
    base = prose(1, 200)
    near = " ".join(w if k % 97 else "other" for k, w in enumerate(base.split()))
    far = " ".join(w if k % 5 else "zzz" for k, w in enumerate(base.split()))
    rows = [(1, base), (2, base), (3, base.upper()), (4, near), (5, far), (6, "one two"), (7, "One, TWO!"), (8, ""), (9, None), (10, "!!! ..."),
            (11, prose(2, 30_000)), (12, prose(3, 50) + " " + prose(4, 40)), (13, prose(5, 60) + " " + prose(4, 40)), (14, "é à über straße 12"), (14, "é à über straße 12")]
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names operators use inside."""
    return spark.createDataFrame(texts, DOC).withColumns({c: F.lit(7) for c in ("score", "sig", "digest", "rep", "size", "place", "bad_id", "many_id", "n_words", "component")})


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 6), (6, 20), (None, 4), (30, 31), (31, 30)] + [(100 + k, 101 + k) for k in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 20: 6, 30: 30, 31: 30} | {100 + k: 100 for k in range(51)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_are_taken_out_exactly(spark, docs):
    left = without_ids(docs, spark.createDataFrame([(1,), (14,), (99,), (None,)], "x long"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert sorted(r.doc_id for r in one_row_each(docs, "doc_id").collect()) == list(range(1, 15))


def test_ngram_join_equals_brute_force(spark, docs, texts):
    sets = {}
    for i, t, *_ in texts:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in linked[i])]) for i in sets}
    # small blocks, so that groups are compared block against block
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs, block=2, verify_block=2).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(linked[i]), root[i], root[i] == i) for i in sets}
    assert got[2].class_id == got[3].class_id == 1 and got[4].class_id == 4
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_bands_meet_the_target_recall():
    bands = ngram_join.plan_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**4) ** bands >= 0.9999 > 1 - (1 - 0.8**4) ** (bands - 1)


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16))
    x = np.repeat(centres, 6, axis=0) + 0.15 * rng.standard_normal((360, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(400, [float(v) for v in x[3]]), (401, [2 * float(v) for v in x[3]])]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (506, [1.0, 2.0]), (507, [2.0, 4.0])]
    table = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>").withColumn("component", F.lit(1))
    got = {r.vec_id: r for r in rp_forest.near_vectors(table, leaf=16, coarse=32, group=64).collect()}
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None, :], 10**9).min(1))
    exact = sum(got[i].n_links == n and got[i].component_id == c for i, n, c in zip(ids, near.sum(1), label, strict=True))
    assert exact >= 0.98 * len(ids)  # measured recall
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506)) and got[507].component_id == 506
    assert rp_forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_leaves_split_again(spark):
    """A sample of eight vectors grows no tree; the one leaf is split by its own vectors, and a dense spot is compared whole."""
    rng = np.random.default_rng(8)
    x = np.vstack([np.repeat(rng.standard_normal((120, 24)), 4, axis=0) + 0.12 * rng.standard_normal((480, 24)),
                   rng.standard_normal(24) * 3 + 0.001 * rng.standard_normal((150, 24))])
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    entries = spark.createDataFrame([(5, k, 24, r.astype("<f8").tobytes()) for k, r in enumerate(m)], "leaf long, rep long, dim int, x binary")
    leaves = defaultdict(set)
    for r in rp_forest._bounded_leaves(entries, 24, 0.2 / 24**0.5, 64, 3).collect():
        leaves[r.leaf].add(r.rep)
        assert r.members > 1
    dense = set(range(480, 630))
    assert all(len(own) <= 64 or len(own & dense) > len(own) / 2 for own in leaves.values()) and any(dense <= own for own in leaves.values())
    got = {r.vec_id: r.n_links for r in rp_forest.near_vectors(table, leaf=16, group=64, sample=8).collect()}
    assert all(got[k] == 149 for k in dense) and np.mean([got[k] == n for k, n in enumerate(near.sum(1))]) >= 0.98


def test_forest_takes_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [5e-324, 0.0]), (6, [1e308, 0.0]), (7, [0.0, -1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_winnowing_equals_brute_force(spark, docs, texts):
    items = [(1, prose(4, 40)), (2, "One TWO"), (3, None), (4, "..."), (5, prose(9, 12)), (10, prose(4, 40)), (6, prose(1, 200).split(" ", 20)[-1])]
    window = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            window[tuple(w[k:k + 13])].add(i)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in window}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in window:
                    found |= window[tuple(w[k:k + size])]
                    hit.update(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in winnow.decontaminate(docs, bench).collect()]
    assert sorted(got) == sorted(want) and any(w[5] for w in want)
    nothing = winnow.decontaminate(docs, bench.limit(0)).collect()
    assert len(nothing) == len(texts) and not any(r.contaminated for r in nothing)
    assert winnow.decontaminate(empty(spark), bench).count() == 0


def test_quality_on_held_out_rows(spark):
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        text = prose(k, 80) if good else (" ".join(w.upper() + "!!" for w in prose(k, 80).split()) if k % 2 else "spam " * 60 + prose(k, 5))
        rows.append((k, text, "en", "s", 1))
        labels.append((k, int(good), None))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None), rows[0]], DOC).withColumn("score", F.lit(1.0))
    table = spark.createDataFrame([*labels, (5, None, 1)], "doc_id long, quality int, toxic int")
    model = nbsvm.fit(docs, table.where("doc_id % 5 <> 0"), "quality")
    got = {r.doc_id: r.score for r in nbsvm.score(docs, model).select("doc_id", "score").collect()}
    held = [k for k in range(240) if k % 5 == 0]
    assert sum((got[k] >= 0.5) == bool(labels[k][1]) for k in held) >= 0.95 * len(held)
    assert 0 <= got[900] <= 1 and got[900] == got[901]
    flat = nbsvm.fit(docs, table.limit(0), "quality")
    assert {r.score for r in nbsvm.score(docs, flat).select("score").collect()} == {0.5}
    assert nbsvm.score(empty(spark), model).count() == 0


def test_log_ratios_and_descent():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])]
    y = np.array([1, 1, 0, 0])
    ratio = nbsvm.log_ratios(rows, y)
    assert ratio[1] > 0 > ratio[4] and abs(ratio[2]) < 1e-12
    w, bias = nbsvm.descend(rows, y, ratio)
    assert all((w[r].sum() / np.sqrt(2) + bias > 0) == (v == 1) for r, v in zip(rows, y, strict=True))


def test_toxicity_restores_disguises(spark):
    bad = ["idiot", "moron", "stupid", "worthless"]
    rows, labels = [], []
    for k in range(300):
        toxic = k % 4 == 0
        w = prose(k, 40, 2000).split()
        w = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], x) for x in w]
        if toxic:
            w[3], w[17] = bad[k // 4 % 4], bad[(k // 4 + 1) % 4]
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(toxic)))
    hidden = ["you 1d10t and m0r0n", "an i d i o t and a s t u p i d one", "stuuuupid w0rthl3ss", "i.d.i.o.t $tupid"]
    clean = ["cab dab ebb version 3.0", "", None, "a b"]
    docs = spark.createDataFrame(rows + [(1000 + k, t, "en", "s", 1) for k, t in enumerate(hidden)] + [(2000 + k, t, "en", "s", 1) for k, t in enumerate(clean)], DOC)
    table = toxicity.character_model(docs)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0"), "toxic", table)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit(0)), model, table).select("doc_id", "score").collect()}
    assert all(got[1000 + k] >= 0.5 for k in range(len(hidden)))
    assert all(got[2000 + k] < 0.5 for k in range(len(clean)))
    held = [k for k in range(300) if k % 5 == 0]
    assert sum((got[k] >= 0.5) == bool(labels[k][1]) for k in held) >= 0.95 * len(held)
    assert toxicity.score(empty(spark), model, toxicity.character_model(empty(spark))).count() == 0


def test_pages_keep_the_article(spark):
    shared = " ".join(f"common{k}" for k in range(30))
    article = "<article><header><h1>Title &amp; more</h1></header><p>One\n <b>two</b>&nbsp;three<br>four<p>Last &lt;b&gt;</p><div class='comments'><p>bad</p></div></article>"
    rows = [(1, "http://a.example/1", f"<html><head><title>x</title><script>'</p>'</script></head><body><nav>Home</nav><div class=ad>Buy</div>{article}<footer>(c)</footer></body>"),
            (2, "http://a.example/2", None), (3, None, ""), (4, "http://a.example/4", "plain text only"), (5, "http://a.example/5", "<p>broken <b>markup <script>never closed"),
            (6, "http://a.example/6", "<div>" + "long " * 50_000 + "</div>")]
    rows += [(k, f"http://b.example/{k}", f"<body><div>{shared}</div><div>only{k} " + " ".join(f"x{k}y{j}" for j in range(25)) + "</div></body>") for k in range(10, 15)]
    rows += [(20, "http://c.example/20", f"<body><div>{shared}</div></body>"), rows[0]]
    got = defaultdict(set)
    for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == {"Title & more\nOne two three four\nLast <b>"}
    assert got[2] == got[3] == {""} and got[4] == {"plain text only"} and got[5] == {"broken markup"}
    assert got[6] == {"long " * 49_999 + "long"}
    assert all(shared not in t and t.startswith(f"only{k}") for k in range(10, 15) for t in got[k])
    assert got[20] == {shared}  # another host: not repeated there
    assert host_suffix.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copied_pages_keep_their_text(spark):
    """Copies, mirrors and crawls of a page are one page; repeats never touch a marked article."""
    nav = " ".join(f"menu{k}" for k in range(30))
    own = {k: prose(k, 60, 5000) for k in range(70, 76)}
    plain = f"<body><div>{own[70]}</div><div>{own[71]}</div></body>"
    inside = f"<p>{own[72]}</p><ul><li>{own[73]}</li></ul><table><tr><td>{own[74]}</td></tr></table><div>{own[75]}</div>"
    rows = [(1, "http://a.example/1", plain), (2, "http://a.example/2", plain.replace("<body>", "<body>\n ")), (3, "http://www.a.example/1", plain),
            (4, "http://a.example/4", f"<nav>{nav}</nav><article>{inside}</article>"), (5, "http://a.example/5", f"<nav>{nav}</nav><article>{inside}</article>"),
            (6, "http://a.example/6", f"<article>{inside}<p>more</p></article>"), (7, "http://a.example/7", f"<body>{inside}</body>"),
            (8, "http://a.example/8", f"<body><div>{nav}</div><div>{prose(76, 60, 5000)}</div></body>")]
    got = {r.page_id: r.text for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    article = "\n".join(own[k] for k in range(72, 76))
    assert got[1] == got[2] == got[3] == f"{own[70]}\n{own[71]}"
    assert got[4] == got[5] == got[7] == article and got[6] == article + "\nmore"
    assert got[8] == prose(76, 60, 5000)  # what markup drops elsewhere is still boilerplate


def test_names_of_frames_do_not_drop_articles():
    for frame in ('<div id="page" class="site has-sidebar">', '<div class="no-sidebar">', '<form id="form1">', '<div class="banner">', "<div class='page-content notice'>"):
        assert host_suffix.blocks_of(f"<body>{frame}<nav>n</nav><article class='post share'><p>one</p></article></div>") == (True, ["one"], ["n"]), frame
    inside = "<section id='related-work'><h2 id='social-history'>a</h2><p class='notice'>b</p></section><p>c <math><mi>x</mi></math> d</p>"
    gone = "<div class='comments-area'>z</div><div class='ad-slot-1'>z</div><form>z</form><aside>z</aside><footer>z</footer>"
    assert host_suffix.blocks_of(f"<article>{inside}{gone}</article>") == (True, ["a", "b", "c x d"], ["z"] * 5)
    assert host_suffix.blocks_of("<div class='site-footer'>f</div><div class='has-sidebar'>text</div>") == (False, ["text"], ["f"])
    assert host_suffix.blocks_of("<div class='widget'><p>all there is</p></div>") == (False, ["all there is"], [])
    assert host_suffix.blocks_of("<section class='comments'><article class='comment'>no</article></section><main>yes</main>") == (True, ["yes"], ["no"])


def test_long_broken_pages_are_linear():
    import time

    start = time.perf_counter()
    for page in ("if a <b " * 120_000, "<div></p>" * 100_000, "<a \"'" * 150_000, "<a '>' " * 130_000 + '"', "<p><li>" * 130_000, "<!" * 400_000, "</x" * 300_000, "<script>" * 100_000):
        host_suffix.blocks_of(page)
    assert time.perf_counter() - start < 60  # about a megabyte each
    assert host_suffix.blocks_of("if a <b and c") == (False, ["if a <b and c"], []) and host_suffix.blocks_of("a <b title='>' x>c</b> d < e") == (False, ["a c d < e"], [])


def test_repeats_equal_brute_force(spark):
    """Blocks of unmarked pages go if more than half their tokens lie in 12-token stretches that another page of the host has."""
    shared = [prose(500 + k, 40, 9000) for k in range(6)]
    rows = []
    for k in range(12):
        host = f"h{k % 2}.example"
        blocks = [shared[(k + j) % 6] for j in range(2)] + [prose(1000 + 10 * k + j, 30, 9000) for j in range(3)] + [shared[k % 6] + " " + prose(2000 + k, 90, 9000)]
        rows.append((k, f"http://{host}/{k}", blocks))
    pages = spark.createDataFrame([(i, u, "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>") for i, u, blocks in rows], "page_id long, url string, html string")
    want = {}
    for i, u, blocks in rows:
        others = {tuple(w[a:a + 12]) for j, v, own in rows if j != i and host_suffix.host_of(v) == host_suffix.host_of(u) for w in [words(" ".join(own))] for a in range(len(w) - 11)}
        flat, cover, keep, at = words(" ".join(blocks)), set(), [], 0
        for a in range(len(flat) - 11):
            if tuple(flat[a:a + 12]) in others:
                cover.update(range(a, a + 12))
        for b in blocks:
            n = len(words(b))
            if len(cover & set(range(at, at + n))) <= n / 2:
                keep.append(b)
            at += n
        want[i] = "\n".join(keep)
    assert {r.page_id: r.text for r in host_suffix.extract(pages).collect()} == want
    assert any("w" in t and len(t.split()) < 250 for t in want.values())


def test_suffix_array_is_sorted_with_its_common_prefixes():
    rng = np.random.default_rng(5)
    for lengths in ([0], [1], [7, 0, 7], [40, 3, 64, 12, 0, 1], [100]):
        streams = [rng.integers(0, 3, n).astype(np.uint64) for n in lengths]
        streams += [s.copy() for s in streams[:2]]
        bounds = np.append(0, np.cumsum([len(s) for s in streams]))
        order, common = host_suffix.suffix_array(np.concatenate(streams), bounds)
        suffixes = [(list(s[i:]), b + i) for s, b in zip(streams, bounds, strict=False) for i in range(len(s))]
        assert [p for _, p in sorted(suffixes)] == order.tolist()
        for x, y, n in zip(sorted(suffixes), sorted(suffixes)[1:], common[1:], strict=False):
            assert n == next((i for i, (u, v) in enumerate(zip(x[0], y[0], strict=False)) if u != v), min(len(x[0]), len(y[0])))


def test_repeats_are_the_same_for_every_cut_into_chunks(spark):
    """Every suffix takes part (repeats of just 6 tokens anywhere), hosts inside a chunk and over its borders alike; repeats of 5 are none."""
    def own(k, j, n):
        return prose(7000 + 10 * k + j, n, 9000)

    rows = [(k, f"http://h{k % 4 // 2}.example/{k}", f"<nav>n</nav><div>{own(k, 0, 5)} {prose(k // 2, 6, 9000)}</div><p>{own(k, 1, 4)} {prose(100 + k // 2, 5, 9000)}</p><footer>f</footer>" if k < 20 else
             f"<nav>{prose(k // 2, 30, 9000)}</nav><article><h1>{own(k, 2, 6)}</h1><p>{prose(3, 30, 9000)}</p></article>") for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [sorted((r.page_id, r.text) for r in host_suffix.extract(pages, chunk=chunk).collect()) for chunk in (1, 60, 400, 1 << 20)]
    assert got[0] == got[1] == got[2] == got[3]
    for k, text in got[0]:
        assert text == (f"{own(k, 1, 4)} {prose(100 + k // 2, 5, 9000)}" if k < 20 else f"{own(k, 2, 6)}\n{prose(3, 30, 9000)}"), k


def test_repeats_decide_notices_inside_an_article(spark):
    """An element of a marked article that is named like a notice goes if other pages of the host have it; the article's own stays, and so does all that is plain."""
    box, passage = prose(1, 20, 9000), prose(2, 40, 9000)
    rows = [(k, f"http://a.example/{k}", f"<nav>n</nav><article><h1>t{k}</h1><div class='newsletter-box'><p>{box}</p></div><p>{passage}</p>"
             f"<p class='notice'>{prose(50 + k, 20, 9000)}</p><div class='share'>more {k}</div></article><footer>{passage}</footer>") for k in range(4)]
    rows += [rows[0], (9, "http://b.example/9", rows[0][2]), (10, "http://b.example/10", rows[0][2].replace("<nav>n", "<nav>another"))]
    got = defaultdict(set)
    for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].add(r.text)
    for k in range(4):
        assert got[k] == {f"t{k}\n{passage}\n{prose(50 + k, 20, 9000)}\nmore {k}"}
    assert got[9] == got[10] == {f"t0\n{box}\n{passage}\n{prose(50, 20, 9000)}\nmore 0"}  # copies are one page: nothing repeats there


def test_a_head_ends_where_the_body_begins():
    for opened in ("<head><title>t</title><meta charset=utf-8><body><p>", "<head><link rel=x><p>", "<HEAD><style>p {}</style>\n", "<head></head><body>", "<head><title>t</title></head><p>"):
        assert host_suffix.blocks_of(f"<html>{opened}main text</p></html>") == (False, ["main text"], [])
    assert host_suffix.blocks_of("<head><title>t</title><article><h1>a</h1></article>b") == (True, ["a"], ["b"])


def test_licences(spark):
    lines = {1: ("Released under the MIT License.", "mit"), 2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"), 3: ("All rights reserved.", "proprietary"),
             4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 5: ("Licensed under the Apache License, Version 2.0.", "apache")}
    rows = [(i, f"{prose(i, 40)}\n{t}\n{prose(i + 50, 200)}") for i, (t, _) in lines.items()] + [(k, prose(k, 120) + "\n" + prose(k + 500, 30)) for k in range(20, 60)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "The license of the poet is poetic."), rows[0], (94, f"{lines[1][0]}\n{lines[4][0]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("x"))
    model = license_scan.fit(docs, sample=200)
    got = defaultdict(list)
    for r in license_scan.scan(docs, model).collect():
        got[r.doc_id].append(r)
    assert {i: got[i][0].families for i in lines} == {i: f for i, (_, f) in lines.items()}
    assert len(got[1]) == 2 and got[94][0].families == "cc-by-nc,mit" and got[94][0].n_license == 2
    assert all(r.families == "" for i, found in got.items() if i >= 20 and i != 94 for r in found)
    assert got[90][0].n_paragraphs == got[91][0].n_paragraphs == 0 and got[1][0].n_paragraphs == 6
    assert license_scan.scan(docs.limit(0), model).count() == 0


def test_licence_threshold_equals_a_search_over_all_paragraphs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.3, 0.31, 0.5, 0.94999, 0.95, 0.99, 1.0, round(0.3 + 0.7 * rng.random(), 4)]), rng.random() < 0.6) for _ in range(300)]
    table = spark.createDataFrame(rows, "p double, plain boolean")
    for total, tail in ((1000, 0.001), (1000, 0.05), (5000, 0.03), (300, 1.0), (0, 0.001)):
        steps = [k / 10_000 for k in range(3000, 9501)]
        fits = [t for t in steps if sum(plain and p >= t for p, plain in rows) <= tail * total]
        assert license_scan.threshold(table, total, tail) == (fits[0] if fits else 0.95)
    assert license_scan.threshold(table.limit(0), 10) == 0.3


def test_planted_notices_are_found(spark):
    """Every notice, whole, inside a longer line and with a year put in; prose beside it stays unmarked."""
    planted = [(family, text) for family, texts in sorted(license_scan.NOTICES.items()) for text in texts]
    rows = [(k, f"{prose(k, 60)}\n{text}\n{prose(k + 900, 60)}") for k, (_, text) in enumerate(planted)]
    rows += [(1000 + k, f"{text} 2019\n{prose(k, 30)}") for k, (_, text) in enumerate(planted)] + [(5000 + k, prose(k, 90)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs, license_scan.fit(docs, sample=200)).collect()}
    hits = [got[k + base].n_license > 0 for k in range(len(planted)) for base in (0, 1000)]
    right = [planted[k][0] in got[k + base].families.split(",") for k in range(len(planted)) for base in (0, 1000)]
    assert np.mean(hits) >= 0.95 and np.mean(right) >= 0.9
    assert not any(got[5000 + k].n_license for k in range(100))


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(k, prose(k, int(rng.integers(1, 60)) * (40 if k % 97 == 0 else 1)), "en", None if k % 6 == 5 else f"s{min(k % 9, 3)}", 1) for k in range(900)]
    rows += [(1000, None, None, "empty", 0), (1001, " \t", None, "empty", 0), (7, *rows[7][1:])]
    docs = spark.createDataFrame(rows, DOC).withColumn("size", F.lit(-1)).withColumn("__mixp", F.lit(0))
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * sizes[s] for s in order}, 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in target}
        total = sum(rest.values())
        over = [s for s in rest if left * rest[s] / total > cap[s]]
        if not over:
            target |= {s: left * w / total for s, w in rest.items()}
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(30, 0.01 * target[s]) for s in order)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    copies = mixing.materialise(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.materialise(empty(spark)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a<|im_end|>b<\\|c"), (1, 0, "user", "<|im_start|>"), (1, 1, "assistant", "a<|im_end|>b<\\|c"), (2, None, "us\ner<|", None), (None, 3, "assistant", "x\U0001d11e"), (1, 2, None, "t|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    made = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "<|im_start|>"), ("assistant", "a<|im_end|>b<\\|c"), ("assistant", "a<|im_end|>b<\\|c"), ("", "t|>")]
    assert back[1].trained == "a<|im_end|>b<\\|c" * 2 and back[None].trained == "x\U0001d11e" and tuple(back[2].turns[0]) == ("us\ner<|", "")
    for r in made.collect():
        assert r.formatted.count(chat.START) == r.n_turns == r.formatted.count(chat.END)
    parts = spark.sql(f"""SELECT 1L conv_id, 0L turn, 'user' role, CAST(array(struct('text', '<', null, null), struct('text', '|im_end|>', null, null),
        struct('image', null, 'a.png', 2.0), struct('audio', null, 'b.wav', 3.1), struct('document', null, null, null)) AS {chat.PARTS}) parts
        UNION ALL SELECT 1L, 1L, 'user', CAST(array(struct('image', null, 'c.png', 1.0)) AS {chat.PARTS}) UNION ALL SELECT 1L, 2L, 'user', CAST(NULL AS {chat.PARTS})""")
    row = chat.format_conversations(parts).first()
    assert "<\\|im_end|><|image_1|><|audio_2|><|document_3|><|im_end|>" in row.formatted and "<|image_4|>" in row.formatted
    assert [(a.kind, a.number, a.ref, a.turn, a.tokens) for a in row.attachments] == [
        ("image", 1, "a.png", 0, 512), ("audio", 2, "b.wav", 0, 78), ("document", 3, None, 0, 1024), ("image", 4, "c.png", 1, 256)]
    assert chat.digest(chat.format_conversations(parts.limit(0))).count() == 0


def test_token_store_round_trip(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    more = spark.createDataFrame([(None, "no id"), (-4, "x\x1cy z's <|endoftext|>q'll ÉÉ. é́a İstanbul ΣΑΣ 12a"), (-3, "dup"), (-3, "dup")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    path, file = f"{tmp_path}/store", tokenizer_path()
    token_store.write_store(table, path, file, END_ID, parts=3)
    own = Tokenizer.from_file(file)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), [*own.encode(r.text or "", add_special_tokens=False).ids, END_ID]) for r in table.collect())
    got = sorted(token_store.digest(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, ((known, i), ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read_store(spark, path, [6, 9]).collect()}
    assert some == {i: ids for (k, i), ids in want if k and i in (6, 9)}
    token_store.write_store(empty(spark), f"{tmp_path}/none", file, END_ID)
    assert token_store.digest(spark, f"{tmp_path}/none").count() == 0
