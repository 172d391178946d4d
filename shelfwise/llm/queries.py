"""The registered queries of the numbered operators: (spark, sf_dir) to a DataFrame, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import ann, bpe, brown, conversations, decontaminate, language, lines, quality, runs, shards, simhash, tokens, toxicity
from shelfwise.llm.common import crc_of, prepare, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    cut = docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return lines.dedup(cut).select("doc_id", "text", "n_lines", F.size("dropped").alias("n_dropped"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    held_out = crc_of("doc_id") % 4 == 2
    languages, vectors = language.prototypes(docs, ~held_out)
    return language.identify(docs, languages, vectors).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "second", "cosine")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(prepare(spark), sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    held_out = toxicity.held_out()
    voter = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, voter).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard_by_bytes(table(prepare(spark), sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(prepare(spark), sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(prepare(spark), sf_dir, "embeddings"))


def op11_class_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    found = brown.score_corpus(docs, crc_of("doc_id") % 10 != 0)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(table(prepare(spark), sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.planted(table(prepare(spark), sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_line_dedup,
        op3_language_id,
        op4_decontamination,
        op5_bpe_round_trip,
        op6_toxicity,
        op7_shards,
        op8_token_counts,
        op9_simhash_near_dedup,
        op10_nearest_vectors,
        op11_class_ngram_scores,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}
ORACLE = {"op2_line_dedup": lines.ORACLE, "op7_shards": shards.ORACLE}
