"""From raw documents to token files: quality, near duplicates, decontamination, mixing, token ids.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read again
as the ``docs`` of the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import mixing, nbsvm, ngram_join, token_store, winnow
from tallyforge.llm.queries import END_ID, tokenizer_path
from tallyforge.llm.shared import fresh_name, held_out, one_row_each, row_keys, small_batches, without_ids
from tallyforge.queries.base import scratch_folder
from tallyforge.sources.readers import read_table


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3).

    Every row is scored on its own whole text, null as the empty one; repeated rows stay or go together, extra columns stay. Without
    labels of both kinds all scores are equal to 0.5, so every row stays; an empty table stays empty.
    """
    small_batches(spark)
    labels = read_table(spark, folder, "labels")
    model = nbsvm.fit(docs, labels.where(~held_out(F.col("doc_id"))), "quality")
    score = fresh_name("quality", docs)
    return nbsvm.score(docs, model, score).where(F.col(score) >= 0.3).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    A document is a distinct (id, text): of rows equal in both one stays, rows of one id with other texts are other documents, and so are
    rows without id. Texts without words are near nothing, so each of them stays. Extra columns stay; an empty table stays empty.
    """
    small_batches(spark)
    keyed, key = row_keys(docs)
    groups = ngram_join.ngram_join(keyed.select(F.col(key).alias("doc_id"), "text"))
    return one_row_each(without_ids(keyed, groups.where("NOT kept").select("doc_id"), key), key).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows.

    Contamination is a fact of a distinct (id, text), so a clean text stays beside a contaminated one of its id, and contaminated rows
    without id go. Null and empty texts have no words and stay; so does every row where the benchmark is empty.
    """
    small_batches(spark)
    keyed, key = row_keys(docs)
    found = winnow.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), read_table(spark, folder, "benchmark"))
    return without_ids(keyed, found.where("contaminated").select("doc_id"), key).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows without words are never taken, null sources are one source, rows equal in id, source and text share a draw; extra columns
    stay, an empty table stays empty.
    """
    small_batches(spark)
    return mixing.materialise(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of the mix, and what is read back from them: doc_id, start, n_tokens, ids_crc32 of each copy.

    Null texts are empty (the end id alone), rows without id come first, repeated rows are kept; an empty table gives no rows.
    """
    small_batches(spark)
    path = f"{scratch_folder(spark)}/tokens"
    token_store.write_store(docs, path, tokenizer_path(), END_ID)
    return token_store.digest(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token ids", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    base = scratch_folder(spark)
    docs = read_table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
