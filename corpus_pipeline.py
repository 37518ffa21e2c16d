"""A training corpus from the table documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. Stages work on all that their predecessor kept. All but the last
return the columns of documents.

Null and empty texts, null ids, repeated rows and empty tables: the quality rules drop documents without words (and rows
whose id is null, as they can't be told apart); rows that share an id stay only if all of them are kept; the
stages after that keep repeated rows that no class or passage takes away. An empty table stays empty through all
stages. Columns besides doc_id, text, lang and source may be null and are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import drop_contaminated
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.ngram_join import keep_one_of_each
from ledgerloom.llm.quality_rules import keep_good
from ledgerloom.llm.token_store import new_store_path, read_documents, write_token_store
from ledgerloom.session import new_folder, table

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; documents without text and rows without an id go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; equal ids stay together."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; an empty benchmark takes nothing away."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights; the copies' ids follow their order in the mixture."""
    return mix_sources(docs).withColumn("doc_id", F.monotonically_increasing_id()).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format; one row per stored copy, read back from the files, in the order of the mixture."""
    path = new_store_path(spark)
    write_token_store(docs, path)
    return read_documents(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

#: SQL can't express the robust estimates and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
