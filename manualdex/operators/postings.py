"""Keys that documents and queries must share, and the inventories built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.functions import text as X

CHUNK_CHARS = 3200
ANY_KEY = "*"
FREQUENT_SHARE = 0.001


def searchable_text() -> Column:
    return F.concat_ws("\n", "filename", "filepath", "content")


def document_keys(text: Column) -> Column:
    """Distinct folded letter and digit runs and whole tokens of a text.

    Both kinds share one name space: most words are their own run, and a key that means the
    other kind to a query only adds a pair for the verification to reject.
    """
    lowered = F.lower(text)
    runs = F.regexp_extract_all(X.fold_lookalikes(lowered), F.lit("[a-zа-яё]+|[0-9]+"), F.lit(0))
    tokens = F.regexp_extract_all(lowered, F.lit("[0-9a-zа-яё]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lit(ANY_KEY)), runs, tokens))


def keys_of(files: DataFrame) -> Column:
    """The stored keys of a catalog version, or those worked out from the texts."""
    return F.col("keys") if "keys" in files.columns else document_keys(searchable_text())


def requirement_keys(kind: Column, value: Column) -> Column:
    """Keys every matching document has. Codes need each of their runs whole, words each
    of their alphanumeric parts whole; a word of punctuation only needs nothing."""
    runs = F.transform(X.code_groups(value), lambda g: X.fold_lookalikes(F.lower(g)))
    parts = F.regexp_extract_all(value, F.lit("[0-9a-zа-яё]+"), F.lit(0))
    return F.when(kind == "tech", runs).otherwise(parts)


def frequent_keys(files: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """Keys held by at least ``share`` of the documents, with their document counts.

    Kept beside a catalog version. It holds at most (average keys per document) / share
    rows however large the catalog is. A key not in it is rarer than all of them.
    """
    total = files.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    keys = files.select(F.explode_outer(keys_of(files)).alias("key"))
    return (
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("documents"))
        .filter(F.col("documents") >= max(2.0, total * share))
    )


def token_postings(files: DataFrame) -> DataFrame:
    """One row per kind, token and document."""
    text = searchable_text()
    kinds = F.array(
        F.struct(F.lit("run").alias("kind"), X.text_runs(text).alias("tokens")),
        F.struct(F.lit("tok").alias("kind"), X.text_tokens(text).alias("tokens")),
    )
    return files.select("id", F.explode_outer(kinds).alias("k")).select(
        "k.kind", F.explode("k.tokens").alias("token"), "id"
    )


def document_codes(files: DataFrame) -> DataFrame:
    """Distinct technical codes of each document, compact and look-alike-folded."""
    codes = F.array_distinct(
        F.transform(
            F.filter(X.raw_tokens(searchable_text()), X.is_tech),
            lambda t: X.fold_lookalikes(X.compact(t)),
        )
    )
    # explode_outer: the plain form would add a filter that works the codes out twice.
    return files.select("id", F.explode_outer(codes).alias("code")).filter("code IS NOT NULL")


def code_inventory(files: DataFrame) -> DataFrame:
    """Number of documents per code; counted map-side before the shuffle."""
    return document_codes(files).groupBy("code").agg(F.count(F.lit(1)).alias("documents"))


def document_chunks(files: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """Text cut into numbered chunks of ``chars`` characters, in one pass over the text."""
    pieces = F.regexp_extract_all(
        F.coalesce("content", F.lit("")), F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0)
    )
    return files.select(
        F.col("id").alias("file_id"), F.posexplode_outer(pieces).alias("chunk_index", "text")
    ).filter("text IS NOT NULL")
