"""The registered queries of this subpackage, each with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    line_dedup,
    lm_scoring,
    minhash,
    mixing,
    passages,
    phrases,
    quality,
    spelling,
    token_counts,
)
from manualdex.llm.tables import held_out, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), threshold=2)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.backoff_scores(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    found = language_id.identify(docs, language_id.learn(labelled))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def quality_rules(docs: DataFrame, labels: DataFrame) -> quality.Rules:
    """Rules for ``labels.quality``, learned outside the held-out fold."""
    return quality.learn(docs, labels.filter(~held_out(F.col("doc_id"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), rules).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_key")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, every=97, ratio=2)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=10, longest=3, covered=50, top=2000)


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("kept")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scores": op2_lm_scores,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_text": op10_html_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_repeated_passages": op13_repeated_passages,
}
