"""The corpus pipeline: documents through the stages below, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and decides on all documents its predecessor kept. All but the last return the
columns of documents; the last returns the token counts and digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import bpe, decontaminate, lines, quality, simhash
from shelfwise.llm.common import prepare, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go."""
    return quality.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, in the same or another document, go; n_chars follows the text."""
    prepare(spark)
    kept = lines.dedup(docs, into="__dropped")
    if "n_chars" in docs.columns:
        changed = F.when(F.size("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of 3-word shingles that link at 2 or fewer differing bits."""
    prepare(spark)
    return simhash.one_of_each(docs, words=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The fitted classifier and the hash functions of the stages have no SQL form; the tests hold run() against a brute-force
#: version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
