"""The queries op1 to op13 over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import centroids, decontamination, html_text, language_id, licences, line_templates, mixing, near_dedup, quality, quotations, token_alignment, token_counts, token_files
from pulsegrid.llm.support import cut, drop_path, scratch_path, table

#: Contracts of op1 and op4.
LINK_PERCENT, LINK_WORDS = 85, 3
BENCHMARK_WORDS = 10


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), LINK_PERCENT, LINK_WORDS)


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotes(table(spark, sf_dir, "conversations"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), importance=mixing.by_size)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    try:
        token_files.write_tokens(table(spark, sf_dir, "documents"), path, word_vocabulary())
        return cut(token_files.read_digest(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    finally:
        drop_path(spark, path)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_vocabulary())


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.drop_templates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.identify(docs, language_id.fit(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_quotations": op2_quotations,
        "op3_html_text": op3_html_text,
        "op4_decontamination": op4_decontamination,
        "op5_quality_rules": op5_quality_rules,
        "op6_licences": op6_licences,
        "op7_mixing": op7_mixing,
        "op8_token_files": op8_token_files,
        "op9_token_counts": op9_token_counts,
        "op10_line_templates": op10_line_templates,
        "op11_centroids": op11_centroids,
        "op12_token_alignment": op12_token_alignment,
        "op13_language_id": op13_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_templates": line_templates.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL}
