"""Near duplicates by an inverted join over MinHash coordinates.

1. Each text gives its set of word shingles, hashed, and K MinHash coordinates. Rows with equal sets
   are one class, so copies of one text cost one narrow row each.
2. A coordinate's value is a token. Two classes are candidates when they collide in at least t of K
   coordinates; t is the largest number that two sets at the threshold miss with a probability of at
   most ``MISS``. Classes that reach t must share a token among the K - t + 1 tokens of each that come
   first in one global order, here rarest first, so only these prefixes are posted. A token that
   one class alone holds can't collide: it takes its place in the prefix and isn't posted, and
   passages that a third of all documents quote are common tokens at the end of the order. The long
   posting lists are skipped, and the rest of a pair's collisions are counted on its signatures.
3. Inside a token's list no pairs are made at first: each class is linked to the list leader with which
   it collides most, links are confirmed on the full sets, and components are formed. The first leaders
   are the classes whose tokens are the most common, which lie in the middle of a group of near copies.
   Lists in one component are done. In the others a class goes when too many of its shingles occur in no other
   open class, as it can't reach the threshold with any. What is left gets another round of leaders. Then
   the same prefix rule is used on whole shingle sets, where it is tightest: two classes at the
   threshold share one of the rarest shingles of each, as many as either may lack and one more. Of each
   shingle's list the classes outside its largest component are compared with every class of another
   component, so no pair that could join two components is left out. They are compared with blocks of
   classes, and a group of near copies makes about as many rows as it has members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manualdex.llm import grams
from manualdex.llm.components import components
from manualdex.llm.tables import WORD, lower_ascii
from manualdex.session import cut_lineage

#: Highest probability with which MinHash may miss a pair that is just at the threshold.
MISS = 1e-6
#: Shingles of all sets of a block.
BLOCK = 1 << 16
#: Shingles of one text that are hashed with all coordinates at once.
CHUNK = 1 << 13


def match_threshold(k: int, similarity: float) -> int:
    """The largest t with P(fewer than t of k coordinates collide) <= ``MISS`` at ``similarity``."""
    below, t = 0.0, 0
    while t < k:
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > MISS:
            break
        t += 1
    return max(t, 1)


def _coordinates(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    xor = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    return xor[:, None], (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def signatures(
    docs: DataFrame, words: int, k: int, seed: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``text_key`` (of the text), ``n``, ``k1``, ``k2`` (size and fingerprint of the set of
    shingles), ``sig`` (K coordinates) per row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _coordinates(k, seed)
        for batch in batches:
            sizes, first_key, second_key, sigs = [], [], [], []
            for _, _, data, offsets in grams.slices(batch.column(1)):
                found, first = grams.words(data, offsets).shingles(words)
                for d in range(len(first) - 1):
                    own = np.unique(found[first[d] : first[d + 1]])
                    sizes.append(len(own))
                    first_key.append(grams.mix(own).sum(dtype=np.uint64))
                    second_key.append(grams.mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64))
                    if len(own):
                        parts = [own[i : i + CHUNK] for i in range(0, len(own), CHUNK)]
                        sigs.append(np.min([((p ^ xor) * times).min(1) for p in parts], axis=0))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum([k if n else 0 for n in sizes]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first_key, np.uint64).view(np.int64)),
                    pa.array(np.array(second_key, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "text_key", "n", "k1", "k2", "sig"],
            )

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, text_key long, n long, k1 long, k2 long, sig array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def shingle_set(text: Column, words: int) -> Column:
    """The distinct shingles of a text as 64-bit hashes, as a column expression."""
    tokens = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.array_distinct(
        F.transform(
            F.array(tokens),
            lambda t: F.when(F.size(t) == 0, F.array().cast("array<bigint>"))
            .when(F.size(t) < words, F.array(F.xxhash64(t)))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1))),
                    lambda i: F.xxhash64(*[F.element_at(t, i + j) for j in range(words)]),
                )
            ),
        )[0]
    )


def _collisions(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _could(a: str, b: str | Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) with 100 * intersection >= percent * union on their full sets."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    sets = (
        pairs.join(left, "a")
        .join(right, "b")
        .select(
            "a", "b", shingle_set(F.col("text_a"), words).alias("sa"), shingle_set(F.col("text_b"), words).alias("sb")
        )
        .select("a", "b", _collisions("sa", "sb").alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    )
    return sets.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    k: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key`` (xxhash64 of the text), ``n_shingles``,
    ``component_id``, ``kept``.

    Words are runs of non-white-space, lower-cased A-Z; a text's set is its distinct shingles of
    ``words`` words, with fewer words the whole sequence. Texts link when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable over links.

    Defined cases: null, empty and white-space texts have an empty set, link with nothing and keep
    their own id. Rows with one id are linked. Rows
    without id stand for their text but give no name: their component is the smallest id reachable,
    or null, and they are kept only if it is null. An empty table gives no rows; other
    columns are ignored.
    """
    t = match_threshold(k, percent / 100)
    rows = cut_lineage(signatures(docs, words, k, id_col=id_col, text_col=text_col))
    # One class per set, numbered when it is written; its text is that of its smallest row.
    classes = cut_lineage(
        rows.filter("n > 0")
        .groupBy("k1", "k2", "n")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("row"),
            F.first("sig").alias("sig"),
        )
        .withColumn("rep", F.monotonically_increasing_id())
    )
    posted = cut_lineage(_posted(classes, k, t))
    candidates = posted.select("rep").distinct()
    sigs = cut_lineage(classes.join(candidates, "rep", "left_semi").select("rep", "n", "sig", "row"))
    wanted = sigs.select("rep", F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    source = _rows(docs, id_col, text_col)
    texts = cut_lineage(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        .groupBy("rep")
        .agg(F.first("text").alias("text"))
    )
    sigs = sigs.select("rep", "n", "sig")
    sides = sigs.toDF("a", "na", "sa"), sigs.toDF("b", "nb", "sb")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that collide in ``t`` coordinates and are confirmed on their full sets."""
        near = (
            pairs.join(sides[0], "a")
            .join(sides[1], "b")
            .filter(_could("na", "nb", percent) & (_collisions("sa", "sb") >= t))
            .select("a", "b")
        )
        return cut_lineage(_confirmed(near, texts, words, percent))

    def placed(found: DataFrame, posts: DataFrame) -> DataFrame:
        known = components(found)
        return posts.join(known, posts["rep"] == known["id"], "left").select(
            *posts.columns, F.coalesce("component", "rep").alias("comp")
        )

    leaders = cut_lineage(_to_leaders(posted.withColumn("comp", F.col("rep")), 0))
    found = linked(leaders)
    posts = cut_lineage(_open(placed(found, posted)))
    shingles = cut_lineage(
        texts.join(posts.select("rep").distinct(), "rep", "left_semi").select(
            "rep", F.explode(shingle_set(F.col("text"), words)).alias("shingle")
        )
    )
    posts = cut_lineage(_able(posts, shingles, percent))
    found = found.union(linked(_to_leaders(posts, 1)))
    posts = cut_lineage(_open(placed(found, posts.drop("comp"))))
    found = found.union(_across(posts, shingles, leaders, percent))

    known = components(found)
    named = classes.join(known, classes["rep"] == known["id"], "left").select(
        "k1", "k2", "n", "row", F.coalesce("component", "rep").alias("comp")
    )
    named = cut_lineage(named)
    names = named.groupBy("comp").agg(F.min("row").alias("first"))
    named = named.join(names, "comp").select("k1", "k2", "n", "first")
    # A class with a third of all rows is one hot key of this join, with one row on the other side.
    filled = F.col("n") > 0
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return (
        rows.select("doc_id", "text_key", "n", "k1", "k2")
        .join(named, ["k1", "k2", "n"], "left")
        .select(
            "doc_id",
            "text_key",
            F.col("n").alias("n_shingles"),
            F.when(filled, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(filled, first).otherwise(True).alias("kept"),
        )
    )


def _posted(classes: DataFrame, k: int, t: int) -> DataFrame:
    """The prefix of each class that can reach ``t`` collisions: ``rep``, ``n``, ``central``, ``token``."""
    tokens = classes.select("rep", "n", F.explode("sig").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # Of a class's k tokens those that no other class has come first, unposted.
    return (
        tokens.join(common, "token")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .filter(F.size("shared") >= t)
        .withColumn("central", F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["df"]))
        .select("rep", "n", "central", F.explode(F.expr(f"slice(shared, 1, size(shared) - {t} + 1)")).alias("p"))
        .select("rep", "n", "central", F.col("p.token").alias("token"))
    )


def _open(posts: DataFrame) -> DataFrame:
    """The rows of lists with several components."""
    lists = posts.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    return posts.join(lists, "token", "left_semi")


def _able(posts: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The rows of classes that can link: ``percent`` of their shingles occur in another open class."""
    common = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = shingles.join(common, "shingle", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    return posts.join(shared, "rep").filter(100 * F.col("shared") >= percent * F.col("n")).select(*posts.columns)


def _to_leaders(posts: DataFrame, turn: int) -> DataFrame:
    """For each class the leader, of a token's list and of another component, with most collisions."""
    first = -F.col("central") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    leaders = (
        posts.groupBy("token")
        .agg(F.min(F.struct(first.alias("first"), "rep", "comp")).alias("l"))
        .select("token", F.col("l.rep").alias("leader"), F.col("l.comp").alias("leader_comp"))
    )
    counted = (
        posts.join(leaders, "token")
        .filter("comp <> leader_comp")
        .groupBy("rep", "leader")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    best = F.max(F.struct("shared", "leader"))["leader"]
    return counted.groupBy(F.col("rep").alias("a")).agg(best.alias("b"))


def _across(posts: DataFrame, shingles: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Links between components that are still apart, confirmed on full sets, one for each class and component.

    Classes with one first leader are dealt into blocks of about ``BLOCK`` shingles. A class outside the
    largest component of a list is sent to the blocks that share a shingle of its prefix. The classes sent to one
    block are put into lots of as many shingles, and a whole lot is compared with a whole block in one row, so only
    links become rows, and of links of a class into one component, which all say the same, the first.
    """
    members = posts.select("rep", "n", "comp").distinct()
    common = shingles.join(members, "rep", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    family = members.join(leaders.toDF("rep", "leader"), "rep", "left").select(
        "rep", "n", "comp", F.coalesce("leader", "rep").alias("family")
    )
    sizes = family.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    family = family.join(sizes, "family").withColumn(
        "block", F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    )
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    rarest = F.filter(F.slice("s", F.lit(1), (lacking + 1).cast("int")), lambda x: x["df"] > 1)
    sets = cut_lineage(
        shingles.join(common, "shingle")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
        .join(family, "rep")
        .select(
            "rep",
            "n",
            "comp",
            "block",
            F.transform(rarest, lambda x: x["shingle"]).alias("prefix"),
            F.transform("s", lambda x: x["shingle"]).alias("whole"),
        )
    )
    narrow = sets.select(F.explode("prefix").alias("shingle"), "rep", "comp", "block")
    largest = (
        narrow.groupBy("shingle", "comp")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("shingle")
        .agg(F.max(F.struct("members", "comp"))["comp"].alias("major"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("shingle", "major")
    )
    lists = cut_lineage(narrow.join(largest, "shingle"))
    minor = lists.filter("comp <> major").select("shingle", F.col("rep").alias("a"))
    sent = minor.join(lists.select("shingle", "block").distinct(), "shingle").select("a", "block").distinct()
    member = F.struct("rep", "n", "comp", "whole")
    blocks = sets.groupBy("block").agg(F.collect_list(member).alias("held"))
    lots = sent.join(members.select(F.col("rep").alias("a"), "n"), "a").groupBy("block").agg(
        F.ceil(F.sum("n") / BLOCK).alias("lots")
    )
    dealt = sent.join(lots, "block").select(
        F.col("a").alias("rep"), F.col("block").alias("to"), F.pmod(F.xxhash64("a", "block"), F.col("lots")).alias("lot")
    )
    asked = dealt.join(sets, "rep").groupBy("to", "lot").agg(F.collect_list(member).alias("asked"))
    # The work of a row is large for its bytes, so rows are dealt over all partitions.
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.join(blocks, F.col("to") == F.col("block")).repartition(parts, "to", "lot").select("asked", "held")
    found = rows.mapInArrow(_linked_sets(percent), "a long, comp long, b long")
    found = found.groupBy("a", "comp").agg(F.min("b").alias("b"))
    return cut_lineage(found.select("a", "b"))


def _linked_sets(percent: int) -> Callable:
    """For each class asked about the smallest class of every other component that it links with, of those held."""

    def parts(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
        rows = rows.values
        rep, n, comp = (rows.field(c).to_numpy() for c in ("rep", "n", "comp"))
        whole = rows.field("whole")
        return rep, n, comp, whole.flatten().to_numpy(), np.concatenate(([0], np.cumsum(whole.value_lengths().to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 3), np.int64)]
            for asked, held in zip(batch.column("asked"), batch.column("held")):
                rep, n, comp, shingles, at = parts(held)
                known, number = np.unique(shingles, return_inverse=True)
                for a, size, own, first, end in zip(*(x := parts(asked))[:3], x[4], x[4][1:]):
                    own_set = x[3][first:end]
                    place = np.minimum(np.searchsorted(known, own_set), len(known) - 1)
                    there = np.zeros(len(known), bool)
                    there[place[known[place] == own_set]] = True
                    both = np.add.reduceat(there[number], at[:-1], dtype=np.int64)
                    linked = (comp != own) & (100 * both >= percent * (size + n - both))
                    by = np.lexsort((rep[linked], comp[linked]))
                    other, b = comp[linked][by], rep[linked][by]
                    new = np.append(True, other[1:] != other[:-1])[: len(other)]
                    found.append(np.stack([np.full(new.sum(), a), other[new], b[new]], axis=1))
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["a", "comp", "b"])

    return run
