"""A corpus pipeline: reject toxic texts, keep one of each near-duplicate group, drop contaminated texts, mix sources, write tokens.

Each stage reads the Parquet files that the one before wrote. All but the last return the columns of documents; the mix returns a
row as often as it takes it, so a doc_id may then repeat.

Null and blank texts aren't toxic, have no near copies and no benchmark words, so the first three stages keep them; the mix takes them as
rows of size 0, and each is written as its end id. Rows without a doc_id stay rows of their own; of rows that share a doc_id the near-copy
stage keeps one. Null sources are a source. Columns besides doc_id, text and source pass through, whatever their names. Empty tables give
empty results; without labels nothing is rejected, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourloom.llm import decontaminate, mixing, ngram_join, store, token_files, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_files(docs, store.new_path(spark, "token-files")))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: Neither a trained model nor a tokenizer can be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
