"""Reading the given tables, and the column rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """The fold of a document: ``crc32`` of its id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``docs`` has it, letter case aside."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to choose among rows in the same way each time."""
    columns = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def kept_rows(docs: DataFrame, keys: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id and ``key`` are in ``keys`` (``id``, ``text_key``), one row for each.

    The texts are shuffled once, by id and key; rows equal in both are reduced before that. Of rows equal in both but
    different elsewhere the one of the smallest hash stays. A null id is an id like others; columns may have any
    names, and come out as they went in.
    """
    own_id, own_key = unused(docs, "_id", "_key")
    marked = docs.withColumns({own_id: F.coalesce(F.col(id_col).cast("string"), F.lit("")), own_key: key})
    wanted = keys.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias(own_id), F.col("text_key").alias(own_key)
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return (
        marked.join(wanted, [own_id, own_key], "left_semi")
        .groupBy(own_id, own_key)
        .agg(F.min_by(row, row_hash(docs)).alias("row"))
        .select("row.*")
    )
