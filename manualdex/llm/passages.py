"""Repeated passages by interval expansion on Burrows-Wheeler transforms, shared out by content.

Every window of ``length`` bytes belongs to the smallest hash of the grams in it, so equal windows, wherever they
start, have one key. Neighbouring windows of one key are a unit, about 185 windows long: the units, not the windows, are
counted. Equal units are summed before anything else, and a unit that occurs twice is repeated as a whole. What
is left to compare are different units of one key; only their texts are fetched, once each.

Those texts are put together, key by key, to chunks of a bounded size. A chunk gets its suffix order and its
Burrows-Wheeler transform; from the whole interval, breadth first, each interval is extended backwards by
every character before it. The end of an interval found at level n is a boundary with a common prefix of n
bytes, known boundaries aren't followed again, and the walk stops at level ``length``: boundaries still
open then lie between suffixes that share ``length`` bytes or more.

A key whose texts pass ``LIMIT`` bytes, as at the edge of a passage that a third of all documents hold, is not
given to one task. Its units are cut into blocks of windows that lie alike to the smallest hash; the bytes common
to all windows of such a block are a finer key. This repeats with ``BLOCKS`` of 64, 8 and 1 windows; equal blocks
are summed each time, and in blocks of one window the key is the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.llm.bit_table import bit_table, is_set
from manualdex.llm.grams import U, buffers, mix
from manualdex.llm.rolling import Stretches, ragged
from manualdex.session import cut_lineage

#: Bytes of a gram, windows of one unit at most, and starts worked on at once (the low bits of a hash hold a place).
GRAM, WIDEST, STARTS = 32, 4096, 1 << 19
_PLACES = U((1 << 20) - 1)
#: Bytes of all texts of a key that one task compares, and of a chunk with one transform.
LIMIT, CHUNK = 1 << 18, 1 << 20
#: Windows of the blocks into which keys beyond the limit are cut, one after the other.
BLOCKS = (64, 8, 1)

_rng = np.random.Generator(np.random.PCG64(13))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that UTF-8 never has: between texts, and at the end of a chunk.
_BETWEEN, _LAST = 255, 254


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w neighbours."""
    m = len(v)
    padded = np.concatenate([v, np.full(-m % w, ~U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: m - w + 1], left[w - 1 : m])


def _anchors(hashes: Stretches, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every window, and the first place of that hash in it."""
    at = np.arange(n - GRAM + 1)
    packed = (hashes.of(at, at + GRAM) & ~_PLACES) | at.astype(np.uint64)
    least = _least(packed, length - GRAM + 1)
    return least >> U(20), (least & _PLACES).astype(np.int64)


def _cuts(new: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that begin where ``new`` holds, none wider than ``widest``."""
    starts = np.flatnonzero(new)
    widths = np.diff(np.append(starts, len(new)))
    run, k = ragged(-(-widths // widest))
    s = starts[run] + k * widest
    return s, np.append(s[1:], len(new))


def _units(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Start, end, key, hash of the text and whether a key occurs at two places, of all units of a text."""
    found = []
    for at in range(0, max(0, len(data) - length + 1), STARTS):
        part = data[at : at + STARTS + length - 1]
        hashes = Stretches(_BYTE[part])
        key, anchor = _anchors(hashes, len(part), length)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        s, e = _cuts(new, WIDEST)
        content = hashes.of(s, e + length - 1) ^ mix((e - s).astype(np.uint64))
        found.append((s + at, e + at, key[s], content, anchor[s] != anchor[e - 1]))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def _units_of(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i in range(batch.num_rows):
                s, e, key, content, twice = _units(data[offsets[i] : offsets[i + 1]], length)
                rows = [np.full(len(s), batch.column(c)[i].as_py()) for c in ("row", "id")]
                columns = [*rows, s, e, key.view(np.int64), content.view(np.int64), twice]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _UNIT_NAMES)

    return run


_UNITS = "row long, id long, s long, e long, key long, content long, twice boolean"
_UNIT_NAMES = ["row", "id", "s", "e", "key", "content", "twice"]


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Places of a byte array, whose last byte occurs once, in the order of the suffixes that begin there."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    keys = np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[order] = starts[np.cumsum(new) - 1]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 8
    while len(open_):
        at = order[open_]
        head, tail = rank[at], rank[at + step]
        by = np.argsort(head * n + tail)
        at, head, tail = at[by], head[by], tail[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        rank[at] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def open_boundaries(transform: np.ndarray, length: int) -> np.ndarray:
    """Of the n + 1 boundaries in a suffix order those between suffixes that share ``length`` bytes or more.

    Works on the Burrows-Wheeler transform alone: intervals are extended backwards, level by level.
    """
    n = len(transform)
    by_byte = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)
    same = transform[by_byte[1:]] == transform[by_byte[:-1]]
    following, previous = np.full(n, n), np.full(n, -1)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        group, place = ragged(high - low)
        at = low[group] + place
        # One interval for each byte before an interval: from its first to its last occurrence in it.
        first = np.sort(step[at[previous[at] < low[group]]])
        last = np.sort(step[at[following[at] >= high[group]]]) + 1
        new = ~known[last]
        low, high = first[new], last[new]
        if not len(low):
            break
        known[high] = True
    return ~known


def repeated_starts(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For every text, which of its windows also start elsewhere in the texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.full(int(sizes.sum()), _BETWEEN, np.uint8)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for a, t in zip(at, texts):
        data[a : a + len(t)] = t
    data[-1] = _LAST
    order = suffix_order(data)
    shared = open_boundaries(data[order - 1], length)
    out = np.zeros(len(data), bool)
    out[order] = shared[:-1] | shared[1:]
    return [out[a : a + max(0, len(t) - length + 1)] for a, t in zip(at, texts)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


_SPANS = "array<struct<a:bigint,b:bigint>>"
_FOUND = f"key long, content long, spans {_SPANS}"


def _compared(length: int) -> Callable:
    """Spans of repeated windows in texts that come sorted by key, worked on in chunks of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def emit(part: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            keys, contents, starts, ends = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sizes = [0]
            for (key, content, _), flags in zip(part, repeated_starts([p[2] for p in part], length)):
                a, b = _spans(flags)
                if len(a):
                    keys.append(key)
                    contents.append(content)
                    starts.append(a)
                    ends.append(b)
                    sizes.append(len(a))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (starts, ends)], ["a", "b"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), spans], ["key", "content", "spans"]
            )

        for batch in batches:
            texts = batch.column("text")
            for key, content, text in zip(*(batch.column(c).to_pylist() for c in ("key", "content")), texts):
                if size >= CHUNK and held[-1][0] != key:
                    yield emit(held)
                    held, size = [], 0
                held.append((key, content, np.frombuffer(text.as_buffer(), np.uint8)))
                size += len(held[-1][2])
        if held:
            yield emit(held)

    return run


def _cut_out(length: int) -> Callable:
    """The texts of wanted units, from the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted")):
                rows = wanted.as_py()
                texts = [data[offsets[i] + r["s"] : offsets[i] + r["e"] + length - 1].tobytes() for r in rows]
                columns = [pa.array([r[c] for r in rows]) for c in ("key", "content", "n", "twice", "hot")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.binary())], ["key", "content", "n", "twice", "hot", "text"]
                )

    return run


_TEXTS = "key long, content long, n long, twice boolean, hot boolean, text binary"


def _blocks(length: int, block: int) -> Callable:
    """Units cut into blocks of windows alike in their place to the key's hash, with finer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, content, n, text in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "n", "text"))):
                data = np.frombuffer(text, np.uint8)
                hashes = Stretches(_BYTE[data])
                _, anchor = _anchors(hashes, len(data), length)
                at = np.arange(len(anchor))
                number = (anchor - at) // block
                new = np.ones(len(at), bool)
                new[1:] = (number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1])
                s, e = _cuts(new, block)
                common = hashes.of(anchor[s] - number[s] * block, anchor[s] - (number[s] + 1) * block + 1 + length)
                finer = mix(common + number[s].astype(np.uint64)) ^ U(block)
                hashed = hashes.of(s, e + length - 1) ^ mix((e - s).astype(np.uint64))
                for k, v in enumerate(
                    ([key] * len(s), [content] * len(s), s, finer.view(np.int64), hashed.view(np.int64), [n] * len(s))
                ):
                    out[k].extend(v)
                out[6] += [text[a : b + length - 1] for a, b in zip(s, e)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
                ["of_key", "of_content", "at", "key", "content", "n", "text"],
            )

    return run


_BLOCK = "of_key long, of_content long, at long, key long, content long, n long, text binary"


def _judged(contents: DataFrame, size: str) -> DataFrame:
    """Contents of keys with more than one occurrence, with what is to be done: ``whole``, ``hot`` and ``compare``."""
    keys = contents.groupBy("key").agg(
        F.sum("n").alias("all"),
        F.count(F.lit(1)).alias("kinds"),
        F.min("n").alias("least"),
        F.max("twice").alias("again"),
        F.sum(size).alias("bytes"),
    )
    keys = keys.filter("all > 1 OR again").select(
        "key",
        F.expr("least < 2 AND (kinds > 1 OR again)").alias("compare"),
        (F.col("bytes") > LIMIT).alias("hot"),
    )
    return contents.join(keys, "key")


def _found(texts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of texts by key (``key``, ``content``, ``text``)."""
    dealt = texts.select("key", "content", "text").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compared(length), _FOUND)


def _whole(contents: DataFrame, width: str) -> DataFrame:
    span = F.struct(F.lit(0).cast("long").alias("a"), F.expr(width).cast("long").alias("b"))
    return contents.filter("n > 1").select("key", "content", F.array(span).alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """One row per content: all its spans in order, those that touch made one."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        touching = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (last["b"] >= x["a"]), touching).otherwise(F.concat(done, F.array(x)))

    every = F.sort_array(F.flatten(F.collect_list("spans")))
    return spans.groupBy("key", "content").agg(every.alias("spans")).withColumn(
        "spans", F.aggregate("spans", F.array().cast(_SPANS), add)
    )


def _hot_found(texts: DataFrame, length: int, blocks: tuple[int, ...]) -> DataFrame:
    """Spans for units of keys beyond the limit, found in smaller and smaller blocks."""
    cut = cut_lineage(texts.mapInArrow(_blocks(length, blocks[0]), _BLOCK))
    contents = cut.groupBy("key", "content").agg(
        F.sum("n").alias("n"), F.min("text").alias("text")
    ).withColumns({"twice": F.lit(False), "size": F.length("text").cast("long")})
    judged = cut_lineage(_judged(contents, "size"))
    found = _whole(judged, f"size - {length - 1}")
    compare = judged.filter("compare")
    if len(blocks) > 1:
        hot = compare.filter("hot")
        found = found.union(_found(compare.filter("NOT hot"), length))
        if not hot.isEmpty():
            found = found.union(_hot_found(hot, length, blocks[1:]))
    places = cut.select("of_key", "of_content", "at", "key", "content")
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b")))
    # Merged on each level, so that a block's spans are one row and a place meets one row at most.
    return places.join(_merged(found), ["key", "content"]).select(
        F.col("of_key").alias("key"), F.col("of_content").alias("content"), moved.alias("spans")
    )


def _held(table, wanted: bool) -> Callable:
    """The rows whose key is in the bit table, or those whose key isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy().view(np.uint64)
            hit = is_set(table.value, row) == wanted
            if hit.any():
                yield batch.filter(pa.array(hit))

    return run


def _cleaned(length: int) -> Callable:
    """Texts without the bytes that their spans of repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py() or b""
                ranges = sorted((r["a"], r["b"] + length - 1) for r in spans.as_py() or [])
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for a, b in ranges:
                    if a > end:
                        kept.append(data[at:a])
                        runs += 1
                    if b > end:
                        removed += b - max(a, end)
                        at = end = b
                kept.append(data[at:])
                out.append((len(data), removed, runs, b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)),
                    pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``row``, ``id``, ``a``, ``b``: starts a to b (exclusive) of repeated windows in texts (``row``, ``id``, ``text``)."""
    sc = texts.sparkSession.sparkContext
    units = cut_lineage(texts.mapInArrow(_units_of(length), _UNITS))
    contents = (
        units.groupBy("key", "content")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("twice").alias("twice"),
            F.min(F.struct("row", "id", "s", "e")).alias("at"),
        )
        .withColumn("size", F.expr(f"at.e - at.s + {length - 1}"))
    )
    judged = cut_lineage(_judged(contents, "size"))
    compare = judged.filter("compare").select("key", "content", "n", "twice", "hot", "at.*")
    known = sc.broadcast(bit_table(compare, F.col("row")))
    wanted = compare.groupBy("row", "id").agg(F.collect_list(F.struct("s", "e", "key", "content", "n", "twice", "hot")).alias("wanted"))
    holders = texts.mapInArrow(_held(known, True), texts.schema).dropDuplicates(["row", "id"])
    cut = cut_lineage(holders.join(wanted, ["row", "id"]).select("text", "wanted").mapInArrow(_cut_out(length), _TEXTS))
    known.destroy()
    found = _whole(judged, f"size - {length - 1}").union(_found(cut.filter("NOT hot"), length))
    hot = cut.filter("hot")
    if not hot.isEmpty():
        found = found.union(_hot_found(hot, length, BLOCKS))
    return units.join(_merged(found), ["key", "content"]).select("row", "id", "s", F.explode("spans").alias("span")).select(
        "row", "id", (F.col("s") + F.col("span.a")).alias("a"), (F.col("s") + F.col("span.b")).alias("b")
    )


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept``.

    Texts are UTF-8 bytes. Every byte goes that a string of ``length`` bytes covers which also starts anywhere else,
    in the same text or another; strings never cross texts and are judged on the input alone. ``n_spans`` counts the
    maximal runs that go, ``kept`` is the rest as bytes.

    Defined cases: a null text is empty. Repeated rows repeat each other's text, whatever their ids; ids may be null or
    repeated. A text shorter than ``length`` stays whole. A text of any length is handled in stretches; one cell has to
    fit a task. An empty table gives no rows; other columns are ignored.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be {2 * GRAM} bytes or more")
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.xxhash64(text).alias("row"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).alias("id"),
        F.col(id_col).alias("doc_id"),
        text.cast("binary").alias("text"),
    )
    spans = cut_lineage(repeated_spans(named.select("row", "id", "text"), length))
    id_type = named.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    # Not destroyed: the result is lazy.
    known = sc.broadcast(bit_table(spans.select("row").distinct(), F.col("row")))
    by_row = spans.groupBy("row", "id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    empty = F.array().cast("array<struct<a: bigint, b: bigint>>").alias("spans")
    touched = named.mapInArrow(_held(known, True), named.schema).join(by_row, ["row", "id"], "left")
    same = named.mapInArrow(_held(known, False), named.schema)
    return (
        touched.select("doc_id", "text", "spans")
        .union(same.select("doc_id", "text", empty))
        .mapInArrow(_cleaned(length), result)
    )
