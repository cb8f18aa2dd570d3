"""From raw documents to token files: quality rules, near duplicates, benchmark passages, mixture, token ids.

Each stage takes what its predecessor kept, as a Parquet table with the columns of documents, and returns what it keeps; the last returns what its token
file holds of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontamination, mixing, near_dedup, quality, token_files
from pulsegrid.llm.queries import BENCHMARK_WORDS, word_vocabulary
from pulsegrid.llm.support import cut, drop_path, scratch_path, table

#: Near duplicates in training data: five-word shingles, a Jaccard similarity of 0.8 or more.
NEAR_PERCENT, NEAR_WORDS = 80, 5

#: The stages go through Python, a classifier and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base counts or are mostly boilerplate lines."""
    return quality.keep_good(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, width=NEAR_WORDS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with ten consecutive words of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources have their target shares of words."""
    return mixing.mixed_rows(docs, importance=mixing.by_size)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the token file."""
    path = scratch_path(spark, "corpus-tokens")
    try:
        token_files.write_tokens(docs, path, word_vocabulary())
        return cut(token_files.read_digest(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    finally:
        drop_path(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("mixture", mixture),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder and read again. A stage's folder goes when its successor is written;
    the last one's holds the result."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
