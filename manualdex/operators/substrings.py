"""Substring look-up by trigrams: which documents may hold a needle, without reading their texts.

An index lies beside a catalog version and has three tables. ``grams`` holds a row per trigram and document, in files
sorted by both, so a look-up reads the row groups of its trigrams and a trigram of every document is
spread over ``LANES`` files. ``counts`` has the number of documents of each trigram, at most one row per trigram there is.
``blocks`` holds the catalog rows in hash blocks of the id, as partitions: rows are fetched for
candidates by partition pruning, other blocks are not opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manualdex.operators.postings import searchable_text
from manualdex.session import cut_lineage

#: Characters of text whose trigrams are worked out at once, so that no long text makes one long array.
PIECE = 1 << 16
#: Rows of a block, and blocks at most (each is a folder).
BLOCK_ROWS, MAX_BLOCKS = 4096, 10_000
#: Trigrams of a needle that are intersected: the rarest, and others up to so many times as common.
MOST_GRAMS, COMMONER = 8, 8
#: Files that the documents of a trigram are dealt over.
LANES = 16
#: Candidates that may be broadcast (8 bytes each); a needle with more is searched by a scan.
MOST_CANDIDATES = 1 << 20


@dataclass(frozen=True)
class Index:
    root: str
    blocks: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{name}")


def pieces(text: Column, chars: int) -> Column:
    """The text cut into pieces of ``chars`` characters, each with the next two, so that no trigram is cut."""
    cut = rf"(?s)(.{{1,{chars}}})(?=(.{{0,2}}))"
    own, more = (F.regexp_extract_all(text, F.lit(cut), F.lit(i)) for i in (1, 2))
    return F.zip_with(own, more, lambda a, b: F.concat(a, b))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[i : i + 3] for i in range(len(needle) - 2)})


def block_of(ids: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(blocks)).cast("int")


def write_index(files: DataFrame, root: str, block_rows: int = BLOCK_ROWS, piece: int = PIECE) -> Index:
    """Write the three tables of a catalog. Letters are lower-cased, null fields left out."""
    spark = files.sparkSession
    rows = files.agg(F.count(F.lit(1))).first()[0]
    index = Index(root, min(MAX_BLOCKS, max(1, -(-rows // block_rows))))
    held = (
        files.select("id", F.explode_outer(pieces(F.lower(searchable_text()), piece)).alias("piece"))
        .select("id", F.explode_outer(trigrams(F.col("piece"))).alias("gram"))
        .filter("gram IS NOT NULL")
    )
    # Dealt by hash: to find ranges, Spark would work all trigrams out a second time.
    (
        held.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(LANES)))
        .repartition("gram", "lane")
        .dropDuplicates(["gram", "lane", "id"])
        .sortWithinPartitions("gram", "id")
        .select("gram", "id")
        .write.mode("overwrite")
        .parquet(f"{root}/grams")
    )
    grams = index.read(spark, "grams")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("documents"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{root}/counts")
    (
        files.withColumn("block", block_of(F.col("id"), index.blocks))
        .repartition("block")
        .sortWithinPartitions("block", "id")
        .write.mode("overwrite")
        .partitionBy("block")
        .parquet(f"{root}/blocks")
    )
    return index


def chosen_grams(spark: SparkSession, index: Index, needle: str) -> list[tuple[str, int]] | None:
    """The trigrams to intersect with their numbers of documents, rarest first; None if one is nowhere."""
    wanted = needle_grams(needle)
    found = index.read(spark, "counts").filter(F.col("gram").isin(*wanted)).collect()  # a row per trigram of the needle
    if len(found) < len(wanted):
        return None
    ranked = sorted((r["documents"], r["gram"]) for r in found)
    return [(g, n) for n, g in ranked[:MOST_GRAMS] if n <= COMMONER * ranked[0][0]]


def candidate_rows(files: DataFrame, index: Index, needle: str) -> DataFrame:
    """Catalog rows that hold all chosen trigrams of a lower-case needle, a superset of those that hold it.

    Needles under three characters, and those whose rarest trigram more than ``MOST_CANDIDATES`` documents have,
    give all rows. Rows come from their blocks; of other blocks nothing is read.
    """
    spark = files.sparkSession
    if len(needle) < 3:
        return files
    chosen = chosen_grams(spark, index, needle)
    if chosen is None:
        return files.filter(F.lit(False))
    if chosen[0][1] > MOST_CANDIDATES:
        return files
    held = index.read(spark, "grams").filter(F.col("gram").isin(*[g for g, _ in chosen]))
    ids = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen))
    # At most as many rows as the rarest trigram has, which is within the bound of a broadcast.
    ids = cut_lineage(ids.select("id", block_of(F.col("id"), index.blocks).alias("block")))
    rows = index.read(spark, "blocks")
    return rows.join(F.broadcast(ids.filter("block >= 0")), ["block", "id"], "left_semi").select(*files.columns)
