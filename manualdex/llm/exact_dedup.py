"""Exact duplicates by content sort, with DataFrame functions only.

Every row gets a sort key: the first characters of its normalised text, the text's SHA-256 and a
salt taken from its id, or without one from its place. ``repartitionByRange`` samples splitters over that key and deals the
texts out by range; each partition sorts externally by key, text and id, so equal texts lie next to
each other, and neighbours are compared in full. The text itself isn't the range key, because
Spark's splitter sample then brings whole texts to the driver; the key is at most 200 bytes.

The salt lets one text that holds a third of all rows spread over ``SALTS`` runs. A run leaves one
narrow row (its largest id and its count), the at most ``SALTS`` runs of a text are merged, and the
result returns to the documents by a join on (SHA-256, salt), in which no key holds more than
one run. The texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manualdex.llm.tables import lower_ascii
from manualdex.session import cut_lineage

#: Runs over which equal texts are spread.
SALTS = 64
#: Characters of the text that lead the sort key.
HEAD = 24


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` says which id of equal texts
    stays, "largest" or "smallest".

    Defined cases: a null text is empty, and all empty texts are one group. A null id counts as
    less preferred than any other; a group with null ids only has a null ``keep_id``. Of rows equal
    in text and id exactly one is kept. An empty table gives no rows; other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    # Rows without id are dealt by where they stand in the table, so that their copies spread as well.
    place = F.monotonically_increasing_id().cast("string")
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        "norm",
        F.sha2("norm", 256).alias("text_sha256"),
        F.substring("norm", 1, HEAD).alias("head"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), place)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    run = ["head", "text_sha256", "salt"]
    id_order = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()
    sorted_run = Window.partitionBy(*run).orderBy("norm", id_order)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row ends a stretch of equal texts when its neighbour's text differs or there is none.
    rows = (
        keyed.repartitionByRange(parts, *run)
        .withColumns(
            {
                "last": ~F.col("norm").eqNullSafe(F.lead("norm").over(sorted_run)),
                "place": F.row_number().over(sorted_run),
            }
        )
        .select("doc_id", "text_sha256", "salt", "last", "place")
    )
    rows = cut_lineage(rows)
    runs = rows.filter("last").select("text_sha256", "salt", F.col("doc_id").alias("best"), "place")
    whole = Window.partitionBy("text_sha256")
    pick = F.max("best") if keep == "largest" else F.min("best")
    runs = runs.select(
        "text_sha256",
        "salt",
        pick.over(whole).alias("keep_id"),
        F.sum(F.col("place").cast("long")).over(whole).alias("group_size"),
        "best",
    )
    # Runs of rows without id may tie; the first salt of the best id keeps its row.
    best = F.col("best").eqNullSafe(F.col("keep_id"))
    runs = runs.withColumn("keeps", best & (F.col("salt") == F.min(F.when(best, F.col("salt"))).over(whole))).drop("best")
    kept = F.col("last") & F.col("keeps")
    return rows.join(runs, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )
