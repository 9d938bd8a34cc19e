"""From raw documents to a training mixture: five stages, each written and read again by the next.

Each stage is one operator of ``manualdex.llm`` over all rows that its predecessor kept, and its decision
takes effect: rows go, or, in the last stage, are repeated and cut to the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.llm import decontaminate, exact_dedup, minhash, mixing, quality, queries
from manualdex.llm.tables import kept_rows, lower_ascii, table
from manualdex.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    rules = queries.quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, rules).filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the largest ``doc_id``."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", "text_sha256")
    sha = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256)
    return kept_rows(docs, kept.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("text_key")), sha)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles the row with the smallest ``doc_id``."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id"), "text_key")
    return kept_rows(docs, kept, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and pass, with ``epoch`` and the ``words`` taken in it."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
]

#: No SQL: the stages fit models, link by MinHash and cut by random keys. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
