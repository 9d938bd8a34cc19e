"""Mixing sources to target weights by hash order, prefix sums and exact cuts.

Documents get a random key (a seeded hash of id and text). Within a source they are sorted by key:
the key's range is cut into equal stretches, which hold about as many documents each because keys
are random, so one source with a third of all rows is sorted by many tasks. Word counts are summed
per stretch, stretches get offsets by a window over those sums, and a window inside each stretch
adds its own prefix sum. A document is taken as far as its source's budget reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manualdex.llm.tables import WORD, row_hash, unused
from manualdex.operators.numbering import number_rows
from manualdex.session import cut_lineage

#: Stretches into which the key range of each source is cut.
STRETCHES = 1024
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target per source: ``source``, ``source_size``, ``target`` from ``source``, ``source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes; no target exceeds ``most`` times its source's size, and what is left over is shared again
    by weight until none is above. That is the level L with sum(min(weight * L, most * size)) = total,
    found with prefix sums over the sources in the order in which they fill up. The table has one
    narrow row per source, so its windows need no partitioning.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    filling = Window.orderBy("full_at", F.col("source").cast("binary").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumns({"weight": weight, "cap": F.lit(float(most)) * F.col("source_size")})
        .withColumns(
            {
                "full_at": F.col("cap") / F.col("weight"),
                "total": F.lit(float(share)) * F.sum("source_size").over(everything),
            }
        )
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
        )
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap")).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``epochs`` (whole passes over the source), ``part`` (words of the document in the last, cut pass)
    and ``taken`` = epochs * size + part. Also ``text_key``, which with the id names the row.

    The budget is the target rounded down to whole words, so a source's taken words differ from its
    target by less than one; only the document at the cut is taken in part.

    Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is a
    source of its own; a source of size 0 has target 0; rows with equal id and text are separate rows
    of which either may come first, with the same counts as a set. An empty table gives no rows.
    Other columns are ignored. The same rows and seed give the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
    )
    key = F.xxhash64("doc_id", "text_key", F.lit(seed))
    # The upper bits of the key are its stretch, so stretches are ranges of keys in order.
    rows = rows.withColumn("key", key).withColumn(
        "stretch", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * STRETCHES).cast("int")
    )
    rows = cut_lineage(rows)
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    by_source = targets(
        sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most
    )
    sums = cut_lineage(
        sums.alias("s")
        .join(by_source.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.source", "stretch", "offset", "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "stretch")
        .orderBy("key", "doc_id", "text_key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("inside")
    return (
        rows.alias("r")
        .join(
            sums.alias("s"),
            (F.col("r.stretch") == F.col("s.stretch")) & F.col("r.source").eqNullSafe(F.col("s.source")),
        )
        .select("doc_id", "r.source", "size", "source_size", "target", "text_key", "offset", "inside")
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least("size", left)).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .drop("offset", "inside")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with ``epoch``, once per pass in which they are taken, and
    ``words``, the words taken in that pass (fewer than the document has only at a source's cut).

    Documents taken with no words are left out. Rows are told apart by id and text. Of rows equal in both and lying
    at a cut, as many are taken as the budget holds, in the order of a hash of the whole row. A column of ``docs``
    named ``epoch`` or ``words`` is replaced; other columns may have any names, and come out as they went in.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    own_id, own_key, own_row, epochs, part, size = unused(docs, "_id", "_key", "_row", "_epochs", "_part", "_size")
    plan = cut_lineage(
        mix(docs, **options)
        .groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own_id), F.col("text_key").alias(own_key))
        .agg(
            F.max("epochs").alias(epochs),
            F.sum("part").alias(part),
            F.max("size").alias(size),
            F.count(F.lit(1)).alias("rows"),
            F.max("taken").alias("taken"),
        )
        .filter("taken > 0")
    )
    # Rows of a group are cut alike unless it lies at a cut; then they are numbered, each with its own part.
    divided = (F.col("rows") > 1) & (F.col(part) > 0) & (F.col(part) < F.col("rows") * F.col(size))
    marked = docs.withColumns(
        {
            own_id: F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            own_key: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    alike = plan.filter(~divided).select(own_id, own_key, epochs, F.least(part, size).alias(part), size)
    taken = marked.join(alike, [own_id, own_key]).drop(own_id, own_key)
    at_cut = plan.filter(divided).select(own_id, own_key, epochs, part, size)
    if not at_cut.isEmpty():
        taken = taken.unionByName(_numbered(docs, marked, at_cut, own_id, own_key, own_row, part, size))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("epoch", "words")]
    passes = F.col(epochs) + F.when(F.col(part) > 0, 1).otherwise(0)
    numbers = F.when(passes > 0, F.sequence(F.lit(1).cast("long"), passes)).otherwise(F.array().cast("array<bigint>"))
    words = F.when(F.col("epoch") <= F.col(epochs), F.col(size)).otherwise(F.col(part))
    return taken.withColumn("epoch", F.explode(numbers)).select(*kept, "epoch", words.alias("words"))


def _numbered(
    docs: DataFrame, marked: DataFrame, at_cut: DataFrame, own_id: str, own_key: str, own_row: str, part: str, size: str
) -> DataFrame:
    """Rows of the groups at a cut, each with the part that is left for it after the ones before it."""
    rows = cut_lineage(marked.join(at_cut, [own_id, own_key]).withColumn(own_row, F.monotonically_increasing_id()))
    narrow = rows.select(
        F.col(own_id).alias("i"), F.col(own_key).alias("k"), row_hash(docs).alias("h"), F.col(own_row).alias("r")
    )
    placed = number_rows(narrow, [F.col("i"), F.col("k"), F.col("h"), F.col("r")], "place")
    first = placed.groupBy("i", "k").agg(F.min("place").alias("first"))
    before = placed.join(first, ["i", "k"]).select(F.col("r").alias(own_row), (F.col("place") - F.col("first")).alias("n"))
    left = F.col(f"rows.{part}") - F.col("before.n") * F.col(f"rows.{size}")
    own = F.greatest(F.lit(0).cast("long"), F.least(F.col(f"rows.{size}"), left))
    columns = [F.col(f"rows.`{c}`") for c in rows.columns if c not in (own_id, own_key, own_row, part)]
    return rows.alias("rows").join(before.alias("before"), own_row).select(*columns, own.alias(part))
