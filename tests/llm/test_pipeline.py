"""The pipeline on the smallest tables, against what its stages must have done."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import ngram_join, winnow
from tallyforge.sources.readers import read_table

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = read_table(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns
        if name == "n-gram Jaccard join":
            assert ngram_join.ngram_join(after).where("n_links > 0").count() == 0
        if name == "benchmark decontamination":
            assert winnow.decontaminate(after, read_table(spark, FOLDER, "benchmark")).where("contaminated").count() == 0
        if k in (0, 1, 2):
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
        counts.append(after.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[5] == counts[4]


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with repeated ids, null ids and texts, columns that clash, and the folder of the tables that stages read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    text = {k: " ".join(f"{k}w{j}" for j in range(60)) for k in range(1, 9)}
    item = " ".join(f"b{j}" for j in range(20))
    rows = [(7, text[1]), (7, text[2]), (7, text[2]), (8, text[1]), (9, text[1] + " end"), (None, text[3]), (None, text[3]), (None, text[4]), (10, text[3]),
            (11, text[5] + " " + item), (11, text[6]), (None, item), (12, None), (13, ""), (14, "!!"), (15, text[7]), (15, text[7])]
    docs = spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 2}", 1) for k, (i, t) in enumerate(rows)], PLAIN)
    docs = docs.withColumns({c: F.lit(1) for c in ("__row", "__quality", "kept", "size", "copies", "many_id", "score")})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder, text, item


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_go_by_rows_not_by_ids(spark, odd):
    docs, folder, text, item = odd
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns and rows_of(good) == rows_of(docs)  # no labels: nothing is rejected
    single = stage["n-gram Jaccard join"](spark, docs, folder)
    # ids 7 and 8 hold the same text; one row without id holds text 3, which id 10 holds as well
    assert single.columns == docs.columns
    assert rows_of(single) == sorted([(8, text[1]), (7, text[2]), (10, text[3]), (None, text[4]), (11, text[5] + " " + item), (11, text[6]), (None, item),
                                      (12, None), (13, ""), (14, "!!"), (15, text[7])], key=str)
    clean = stage["benchmark decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert rows_of(clean) == [r for r in rows_of(docs) if item not in (r[1] or "")]
    mixed = stage["mixing sources"](spark, docs, folder)
    assert mixed.columns == docs.columns and set(rows_of(mixed)) <= set(rows_of(docs)) and not {None, ""} & {t for _, t in rows_of(mixed)}
    assert stage["token ids"](spark, docs, folder).count() == docs.count()


def test_stages_take_empty_tables(spark, odd):
    docs, folder, _, _ = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "token ids" or out.columns == docs.columns)
