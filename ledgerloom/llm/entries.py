"""The registered queries of this subpackage: thin calls of its operators on the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import sql
from ledgerloom.llm.decontaminate import find_benchmark
from ledgerloom.llm.divergence import audit
from ledgerloom.llm.html_text import extract_main_text
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.merkle import digests, manifest
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.ngram_join import near_duplicate_classes
from ledgerloom.llm.quality_rules import judge
from ledgerloom.llm.recurrent_lm import score_documents
from ledgerloom.llm.substring_dedup import remove_copied_substrings
from ledgerloom.llm.token_store import new_store_path, read_documents, write_token_store
from ledgerloom.llm.toxicity import detect
from ledgerloom.llm.warc import new_archive_path, read_pages, write_pages
from ledgerloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.array_join("kept_lines", ",").cast("binary")).alias("kept_md5")
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("mix_copies").cast("long").alias("n_copies"),
        F.col("mix_copy").cast("long").alias("copy"),
        F.round("mix_rate", 6).alias("rate"),
        F.col("mix_key").alias("order_key"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_store_path(spark)
    write_token_store(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copied_substrings(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_archive_path(spark)
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return digests(manifest(table(spark, sf_dir, "documents"), more, tampered))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_source_mixing": op4_source_mixing,
        "op5_html_extraction": op5_html_extraction,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity": op7_toxicity,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_token_id_output": op9_token_id_output,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_warc": op11_warc,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": sql.OP2,
        "op3_benchmark_decontamination": sql.OP3,
        "op4_source_mixing": sql.OP4,
        "op10_substring_dedup": sql.OP10,
        "op11_warc": sql.OP11,
        "op12_merkle_manifest": sql.OP12,
        "op13_source_divergence": sql.OP13,
    }
