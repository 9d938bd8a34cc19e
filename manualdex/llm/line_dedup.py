"""Near-equal lines by a segment-partition edit join, with DataFrame functions only.

Two lines within ``threshold`` edits share a segment: cut the shorter into threshold + 1 segments, and one of them
stands unchanged in the longer one, at one of a few places that its length allows. So every line posts
its segments under (its length, segment number, segment), and probes for every length that a partner may
have, at every place that a segment can have moved to, under the same kind of key.

Equal lines are one class first, known by two hashes, so only different lines post and probe, and only narrow rows
are shuffled from then on. A first pass counts which keys several lines meet under, by their first bits; a second keeps
the posts and probes of those alone. The texts of the lines left are picked out where they lie, so that the texts of all
lines are shuffled once only. Each gets a sketch, the counts of 64 kinds of characters modulo 4: an edit changes two
counts by one at most, so lines whose counts differ by more than 2 * threshold in sum are no partners, and that is
tested inside the join by counting bits. Each pair that passes is verified by an edit distance whose band of
2 * threshold + 1 cells is one machine word, moved along the lines character by character.

A list of one key is first linked to its leader alone; only lists that still hold several components are
joined with themselves, and then only rows outside their largest component with those of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.llm.components import components
from manualdex.session import cut_lineage

#: Lines of up to two to this power of characters have their whole common start cut off.
LONGEST_BITS = 20
#: First bits of a key by which it is counted.
MARK_BITS = 48
#: Most marks or line numbers (8 bytes each) that are broadcast; of more, a table of bits is.
BROADCAST_MARKS = 1 << 21
#: Bits of that table, as a power of two; it is broadcast in words of 64.
TABLE_BITS = 27
#: First characters of the longer line after which a pair that has used up its edits is dropped.
EARLY = 32
#: Kinds of characters that a sketch counts, by their code points.
KINDS = 64


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` of ``parts``: even sizes, the longer ones last."""
    even, short = F.floor(length / parts).cast("int"), parts - (length % parts)
    start = (i - 1) * even + F.greatest(i - 1 - short, F.lit(0)) + 1
    return start.cast("int"), (even + F.when(i > short, 1).otherwise(0)).cast("int")


def places(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, move) of all probes that two lines within the threshold may need."""
    out = []
    for longer in range(threshold + 1):
        for i in range(1, threshold + 2):
            low = max(-(i - 1), longer - (threshold + 1 - i))
            high = min(i - 1, longer + (threshold + 1 - i))
            out += [(longer, i, move) for move in range(low, high + 1)]
    return out


def _posts(lines: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """``id``, ``n``, ``key``, ``posted`` (or else only probed) of ``lines`` (``id``, ``line``).

    The probes are dealt out as rows first, so that one short expression makes the key of each. Lines of one byte a
    character are cut as bytes, without counting characters; their keys are the same either way.
    """
    probes = F.array(*[
        F.struct(F.lit(longer).alias("longer"), F.lit(i).alias("i"), F.lit(move).alias("move"))
        for longer, i, move in places(threshold)
    ])
    n, parts = F.col("n"), threshold + 1
    start, size = _segment(F.col("partner"), F.col("p.i"), parts)

    def key(cut: Column) -> Column:
        return F.xxhash64("partner", F.col("p.i"), F.substring(cut, F.col("at"), F.col("size")))

    return (
        lines.select("id", "line", F.length("line").alias("n"), F.col("line").cast("binary").alias("bytes"))
        .filter(n >= min_chars)
        .select("id", "line", "n", "bytes", F.explode(probes).alias("p"))
        .withColumn("partner", n - F.col("p.longer"))
        .filter(F.col("partner") >= min_chars)
        .withColumns({"at": start + F.col("p.move"), "size": size})
        .filter("at >= 1 AND at + size - 1 <= n")
        .select(
            "id",
            "n",
            F.when(F.length("bytes") == n, key(F.col("bytes"))).otherwise(key(F.col("line"))).alias("key"),
            ((F.col("p.longer") == 0) & (F.col("p.move") == 0)).alias("posted"),
        )
    )


def _sketch(line: Column) -> Column:
    """How often a line has characters of each of the ``KINDS``, modulo 4, a bit of ``x`` and one of ``y`` for each kind.

    The bits are 00, 01, 11, 10 for 0 to 3: one more or less of a kind changes one bit.
    """
    none = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def add(state: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % KINDS).cast("int"))
        # Where both bits are equal the second changes, else the first.
        same = F.bitwise_not(state["x"].bitwiseXOR(state["y"])).bitwiseAND(bit)
        return F.struct(
            state["x"].bitwiseXOR(same.bitwiseXOR(bit)).alias("x"), state["y"].bitwiseXOR(same).alias("y")
        )

    return F.aggregate(F.split(line, ""), none, add)


def _apart(a: str, b: str) -> Column:
    """Sum of the differences of the counts of two sketches, around 4."""
    return F.bit_count(F.col(f"{a}.x").bitwiseXOR(F.col(f"{b}.x"))) + F.bit_count(F.col(f"{a}.y").bitwiseXOR(F.col(f"{b}.y")))


def _among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``keys`` (that column alone, numbers).

    Few keys are broadcast. Of many, a table of bits of fixed size is, and only the rows that it lets through are
    joined by a shuffle.
    """
    if keys.count() <= BROADCAST_MARKS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    place = F.xxhash64(key).bitwiseAND((1 << TABLE_BITS) - 1)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    table = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    table = table.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(1) == 1
    through = rows.withColumn("word", word).join(F.broadcast(table), "word").filter(held).drop("word", "bits")
    return through.join(keys, key, "left_semi")


def within(a: Column, b: Column, threshold: int, chars: int | None = None) -> Column:
    """Whether the edit distance of two lines is at most ``threshold``.

    With ``chars``, whether it can be: so many characters of the longer line are passed with some cell still reached.

    One pass over the longer line with the band of the distance matrix around its diagonal in one word:
    bit k of a state word for e errors says that the shorter line's prefix that ends k - threshold places
    from the diagonal is reached with at most e errors.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    long_side = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    short_side = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    if chars:
        long_side, short_side = F.substring(long_side, 1, chars), F.substring(short_side, 1, chars + threshold)
    # Worked out once a pair, as bound values, and not again for every character.
    sides = F.struct(
        F.split(long_side, "").alias("long"),
        F.split(short_side, "").alias("short"),
        F.length(long_side).alias("n"),
        F.length(short_side).alias("size"),
    )
    # Before the first character: prefix j = k - threshold is reached by j insertions.
    start = [sum(1 << (threshold + j) for j in range(e + 1)) for e in range(threshold + 1)]

    def step(sides: Column, state: Column, c: Column) -> Column:
        row = state["row"] + 1
        # Cell k of this row is prefix j = row + k - threshold of the shorter line.
        equal = F.lit(0)
        for k in range(width):
            j = row + (k - threshold)
            hit = (j >= 1) & (j <= sides["size"]) & F.get(sides["short"], (j - 1).cast("int")).eqNullSafe(c)
            equal = equal + F.when(hit, 1 << k).otherwise(0)
        out = []
        for e in range(threshold + 1):
            own = state[f"s{e}"]
            # A match keeps the diagonal; a cell's diagonal neighbour has the same k.
            reached = own.bitwiseAND(equal)
            if e:
                before, now = state[f"s{e - 1}"], out[e - 1]
                reached = (
                    reached.bitwiseOR(before)  # substitution
                    .bitwiseOR(F.call_function("shiftright", before, F.lit(1)))  # the longer line's character goes
                    .bitwiseOR(F.call_function("shiftleft", now, F.lit(1)))  # one of the shorter line is put in
                ).bitwiseAND(full)
            out.append(reached)
        return F.struct(row.alias("row"), *[o.alias(f"s{e}") for e, o in enumerate(out)])

    first = F.struct(F.lit(0).alias("row"), *[F.lit(s).alias(f"s{e}") for e, s in enumerate(start)])

    def decide(sides: Column) -> Column:
        last = F.aggregate(sides["long"], first, lambda state, c: step(sides, state, c))
        if chars:
            return last[f"s{threshold}"] != 0
        end = threshold - (sides["n"] - sides["size"])
        reached = F.call_function("shiftright", last[f"s{threshold}"], end).bitwiseAND(1) == 1
        return F.when(sides["n"] - sides["size"] <= threshold, F.coalesce(reached, F.lit(False))).otherwise(False)

    return F.transform(F.array(sides), decide)[0]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key``, ``place`` (from 0), ``line`` (outer spaces and tabs gone) of every line that isn't blank.

    ``text_key`` is null for rows with an id; rows without one are told apart by two hashes of their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.when(F.col(id_col).isNull(), F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")))
    return (
        docs.select(
            F.col(id_col).alias("doc_id"),
            own.alias("text_key"),
            F.posexplode(F.split(text, "\n")).alias("place", "line"),
        )
        .withColumn("line", F.trim(F.col("line"), F.lit(" \t\r")))
        .filter("line <> ''")
    )


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``id``, two hashes that name a line."""
    return rows.withColumn("id", F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")))


def line_classes(
    docs: DataFrame, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = None
) -> DataFrame:
    """One row per line that isn't blank: ``doc_id``, ``text_key``, ``place``, ``first_doc``, ``first_place``, ``kept``.

    Lines belong together when at most ``threshold`` edits of single characters part them, directly or
    over other lines. The first (``first_doc``, ``first_place``) of a class is kept. Lines of up to
    ``threshold`` characters, which as many edits replace whole, belong to equal ones only; ``min_chars`` raises
    that bound for callers to whom short lines that differ are different.

    Defined cases: null and empty texts have no lines. Rows with one id count as one document, and so do
    rows without id that have one text (``text_key``); these sort after all others, by the hashes. Lines
    equal in document and place are kept or dropped together. Lines of any length are compared whole. An
    empty table gives no rows; other columns are ignored.
    """
    least = max(threshold + 1, min_chars or 0)
    every = _named(lines(docs, id_col, text_col))
    seen = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")
    found = cut_lineage(every.select("id", seen.alias("at")))
    first = found.groupBy("id").agg(F.min("at").alias("at"))
    # Different lines are numbered when they are written, as numbers are half as wide as names.
    different = cut_lineage(
        _named(every.select("line").distinct())
        .withColumnRenamed("id", "name")
        .withColumn("id", F.monotonically_increasing_id())
    )
    posts = _posts(different, threshold, least)
    # Most keys are one line's own. They are found by counting marks, which are shorter than keys; a mark that two
    # keys share only lets rows through that the lists below drop.
    posts = posts.withColumn("mark", F.shiftrightunsigned("key", 64 - MARK_BITS))
    marks = cut_lineage(
        posts.groupBy("mark")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("posted").cast("int")).alias("posted"))
        .filter("n > 1 AND posted = 1")
        .select("mark")
    )
    open_posts = cut_lineage(_among(posts, "mark", marks).drop("mark").distinct())
    # A list's leader is its smallest posted line.
    lists = (
        open_posts.groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.when(F.col("posted"), F.col("id"))).alias("leader"))
        .filter("low <> high AND leader IS NOT NULL")
        .select("key", "leader")
    )
    open_posts = cut_lineage(open_posts.join(lists, "key"))
    linked = cut_lineage(open_posts.select("id").distinct())
    texts = cut_lineage(_among(different.select("id", "line"), "id", linked).withColumn("sketch", _sketch(F.col("line"))))
    open_posts = cut_lineage(open_posts.join(texts.select("id", "sketch"), "id"))
    texts = texts.select("id", "line")
    leaders = open_posts.filter("posted AND id = leader").select(
        "key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")
    )
    to_leader = (
        open_posts.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        .join(leaders, "key")
        .filter(_may_link(threshold) & (F.col("a") != F.col("b")))
        .select("a", "b")
        .distinct()
    )
    known = cut_lineage(components(_verified(to_leader, texts, threshold)))
    placed = cut_lineage(
        open_posts.join(known, open_posts["id"] == known["id"], "left").select(
            "key", open_posts["id"], "n", "sketch", "posted", F.coalesce("component", open_posts["id"]).alias("comp")
        )
    )
    largest = (
        placed.groupBy("key", "comp")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("key")
        .agg(F.max(F.struct("members", "comp"))["comp"].alias("major"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("key", "major")
    )
    placed = placed.join(largest, "key")
    minor = placed.filter("comp <> major").select(
        "key", *[F.col(c).alias(f"{d}a") for c, d in (("n", "n"), ("sketch", "s"), ("comp", "c"), ("posted", "p"))], F.col("id").alias("a")
    )
    other = placed.select(
        "key", *[F.col(c).alias(f"{d}b") for c, d in (("n", "n"), ("sketch", "s"), ("comp", "c"), ("posted", "p"))], F.col("id").alias("b")
    )
    across = (
        minor.alias("x")
        .join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("ca") != F.col("cb")) & (F.col("pa") | F.col("pb")) & _may_link(threshold))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    more = _verified(across, texts, threshold)
    known = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    linked = different.select("id", "name").join(known, "id").select(F.col("name").alias("id"), "component")
    member = cut_lineage(first.join(linked, "id", "left"))
    # Lines without a link are their own heads, and only the others are grouped.
    heads = member.filter("component IS NOT NULL").groupBy("component").agg(F.min("at").alias("head"))
    heads = (
        member.join(heads, "component")
        .select("id", "head")
        .union(member.filter("component IS NULL").select("id", F.col("at").alias("head")))
    )
    return (
        found.select("id", "at")
        .join(heads, "id")
        .select(
            F.col("at.doc_id").alias("doc_id"),
            F.col("at.text_key").alias("text_key"),
            F.col("at.place").alias("place"),
            F.col("head.doc_id").alias("first_doc"),
            F.col("head.place").alias("first_place"),
            (F.col("at") == F.col("head")).alias("kept"),
        )
    )


def _may_link(threshold: int) -> Column:
    return (F.abs(F.col("na") - F.col("nb")) <= threshold) & (_apart("sa", "sb") <= 2 * threshold)


def _shared_head(a: str, b: str) -> Column:
    """How many characters two different strings have in common at their start, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(LONGEST_BITS, -1, -1)])

    def longer(n: Column, step: Column) -> Column:
        same = F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)
        return F.when(same, n + step).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs`` of lines (``a``, ``b``) whose edit distance is at most ``threshold``.

    What two lines have in common at both ends doesn't change their distance and is cut off first. The
    work of a pair is large for its bytes, so pairs are dealt over all partitions.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = (
        cut_lineage(pairs)
        .join(texts.toDF("a", "line_a"), "a")
        .join(texts.toDF("b", "line_b"), "b")
        .repartition(parts)
    )
    for _ in range(2):
        cut = both.withColumn("head", _shared_head("line_a", "line_b")).select(
            "a",
            "b",
            *[F.reverse(F.substring(c, F.col("head") + 1, F.length(c))).alias(c) for c in ("line_a", "line_b")],
        )
        # Written, as the filter would else be pushed below and hold the cuts many times over.
        both = cut_lineage(cut)
    # Most pairs differ from the start of what is left of them.
    a, b = F.col("line_a"), F.col("line_b")
    near = F.when(within(a, b, threshold, EARLY), within(a, b, threshold)).otherwise(False)
    return cut_lineage(both.filter(near).select("a", "b"))


def deduplicated(
    docs: DataFrame, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = None
) -> DataFrame:
    """One row per document that has lines: ``doc_id``, ``n_lines``, ``n_dropped``, ``dropped`` (places, in order).

    Documents are as in ``line_classes``: rows without id give one row for each text.
    """
    found = line_classes(docs, threshold, id_col, text_col, min_chars)
    # Copies of a document without id hold the same places; each counts once.
    places = found.groupBy("doc_id", "text_key", "place").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    once = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.col("rows"))
    return (
        places.groupBy("doc_id", "text_key")
        .agg(
            F.sum(once).alias("n_lines"),
            F.sum(F.when(F.col("kept"), 0).otherwise(once)).cast("long").alias("n_dropped"),
            F.sort_array(F.collect_list(F.when(~F.col("kept"), F.array_repeat("place", once.cast("int"))))).alias("dropped"),
        )
        .select("doc_id", "n_lines", "n_dropped", F.flatten("dropped").alias("dropped"))
    )
