"""From documents to token ids: five stages, each one operator, each written and read again by the next.

A stage takes ``(spark, docs, sf_dir)``, works on everything that the one before has kept and returns a
DataFrame; all but the last return the columns of ``documents``. NULLs, empty texts and empty tables are
treated as the operators say: documents without a letter go with the first stage, all others stay until a
stage has a reason against them. A document that has lost lines keeps its row, with ``n_chars`` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabpact.llm import decontamination, language, line_dedup, pieces, simhash
from tabpact.llm.common import table
from tabpact.staging import new_folder, remove, stage_at, temporary_folders


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not tell go."""
    return language.keep_known(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that has them."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids of the text, their number, and whether they decode to the text (a NULL text has none)."""
    encoded = pieces.encode(docs, checked=True)
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark_items),
    ("sentencepiece", token_ids),
]

#: SQL cannot express the compression, the fingerprints, the walks and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; only the last one's table is left."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with temporary_folders(spark):
            docs, _ = stage_at(function(spark, docs, sf_dir), path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
