"""Phrase collocations by SON partitioning: locally frequent phrases first, then exact global counts.

The partitions of the table are dealt over ``shards``. A phrase with ``support`` occurrences has at least
``support / shards`` of them in one shard, so each shard is mined completely at that lowered support, level
by level: words and pairs in one scan, then longer phrases whose two shorter parts are frequent somewhere.
The union of what is frequent in any shard contains every globally frequent phrase; a last scan counts
all of it exactly, by the phrases themselves. A shard isn't a task: its counts are summed by shuffling
64-bit keys, so it may be of any size.

While candidates are mined, a phrase is named by ``KEY_BITS`` bits of its hash, in one number with the shard; phrases
that share them are mined together, which can only raise their count. A scan tests candidates against a bit table of fixed
size (16 MB, whatever the input), at two places. A bit that is set wrongly costs a row and changes nothing, as wrong candidates fail the exact support.
Every task sums its own counts before it emits, so the most frequent word is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manualdex.llm.bit_table import KEY_BITS, bit_table, is_set
from manualdex.llm.grams import LOWER, U, buffers, mix
from manualdex.llm.rolling import Stretches, ragged
from manualdex.operators.topk import top_k
from manualdex.session import cut_lineage

#: Bytes of text worked on at once, counts that a task gathers before it emits them, and rows emitted at once.
SLICE, GATHERED, EMITTED = 1 << 20, 1 << 21, 1 << 16

_rng = np.random.Generator(np.random.PCG64(12))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes between pieces: full stop, comma, semicolon, colon, exclamation and question mark, line ends.
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _PIECE.copy()
_GAP[[32, 9]] = True
#: Steps of the score by which candidates are counted before the best are sorted.
_STEPS = 1000

#: Bits of a phrase's hash by which it is mined.
_KEY = U((1 << KEY_BITS) - 1)

_COUNTED = "key long, c long"
_NAMED = "name string, c long"


class _Words:
    """The words of a stretch of texts: their bytes, hashes, pieces and languages."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.data = data = LOWER[data]
        gap = _GAP[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[:1], before[1:], after[-1:], after[:-1] = True, gap[:-1], True, gap[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = True
        after[offsets[1:][filled] - 1] = True
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.hashes = Stretches(_BYTE[data]).of(self.starts, self.ends)
        text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.lang = langs[text]
        piece = np.cumsum(_PIECE[data], dtype=np.int64)[self.starts]
        self.new = np.ones(len(text), bool)
        self.new[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        self.piece = np.cumsum(self.new)

    def phrases(self, size: int, lang_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and key of every phrase of ``size`` words; the key covers the language too."""
        count = max(0, len(self.starts) - size + 1)
        at = np.flatnonzero(self.piece[:count] == self.piece[size - 1 :][:count])
        h = lang_hash[self.lang[at]] + U(size)
        for k in range(size):
            h = h + self.hashes[at + k] * _PLACE[k]
        return at, mix(h)

    def spelled(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases beginning at the words ``at``, joined by one space."""
        lengths = np.zeros((len(at), size), np.int64)
        for k in range(size):
            lengths[:, k] = self.ends[at + k] - self.starts[at + k] + (k < size - 1)
        group, place = ragged(lengths.ravel())
        first = np.stack([self.starts[at + k] for k in range(size)], axis=1).ravel() if len(at) else at
        source = first[group] + place
        out = self.data[np.minimum(source, len(self.data) - 1)]
        last = place == lengths.ravel()[group] - 1
        out[last & (group % size < size - 1)] = 32
        ends = np.concatenate(([0], np.cumsum(lengths.sum(axis=1)))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(out))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Bytes, text offsets and language numbers of about ``SLICE`` bytes; long texts are cut between pieces."""
    lang = batch.column("lang").dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    data, offsets = buffers(batch.column("text"))
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = min(at + SLICE, stop)
        if to < stop:
            part = data[at:to]
            breaks = np.flatnonzero(_PIECE[part[-(1 << 16) :]])
            edge = offsets[np.searchsorted(offsets, to, side="right") - 1]
            inner = to - min(len(part), 1 << 16) + breaks[-1] + 1 if len(breaks) else at
            if max(edge, inner) > at:
                to = int(max(edge, inner))
            else:  # one piece longer than a slice stays whole
                rest = np.flatnonzero(_PIECE[data[to:stop]])[:1]
                nxt = offsets[np.searchsorted(offsets, to, side="left")]
                to = int(min(nxt, to + rest[0] + 1 if len(rest) else stop))
        first = np.searchsorted(offsets, at, side="right") - 1
        last = np.searchsorted(offsets, to, side="left")
        inside = np.clip(offsets[first : last + 1], at, to) - at
        yield data[at:to], inside, codes[first:last], names
        at = to


def _lang_hash(names: list[str]) -> np.ndarray:
    digests = [hashlib.blake2b(n.encode(), digest_size=8).digest() for n in names]
    return np.array([int.from_bytes(d, "little") for d in digests], np.uint64)


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


def _parts(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a size that neither side has to hold many of."""
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
    for at in range(0, whole.num_rows, EMITTED):
        yield whole.slice(at, EMITTED)


def _mine(sizes: list[int], table, shards: int) -> Callable:
    """Counts of all phrases of the given sizes, of the longer ones those whose shorter parts are in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % shards
        gathered: dict[int, list[np.ndarray]] = {s: [] for s in sizes}

        def emit(size: int) -> Iterator[pa.RecordBatch]:
            h, c = _summed(gathered[size])
            gathered[size] = []
            yield from _parts([(h | U(shard << KEY_BITS)).view(np.int64), c], ["key", "c"])

        for batch in batches:
            for data, offsets, langs, names in _slices(batch):
                words, lang_hash = _Words(data, offsets, langs), _lang_hash(names)
                for size in sizes:
                    at, h = words.phrases(size, lang_hash)
                    if table is not None and size > 2 and len(at):
                        ok = np.zeros(len(words.starts) + 1, bool)
                        shorter_at, shorter = words.phrases(size - 1, lang_hash)
                        ok[shorter_at] = is_set(table.value, shorter & _KEY, twice=True)
                        h = h[ok[at] & ok[at + 1]]
                    gathered[size].append(h & _KEY)
                    if sum(map(len, gathered[size])) >= GATHERED:
                        yield from emit(size)
        for size in sizes:
            if gathered[size]:
                yield from emit(size)

    return run


def _count(sizes: list[int], table) -> Callable:
    """The phrases themselves with their counts, for all that the table holds, and all words as an empty phrase.

    A name is the language, a tab, which no word holds, and the phrase; names are emitted in order, so that
    neighbours begin alike and take little room in the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            h, c = (np.concatenate([k[j] for k in kept]) for j in range(2))
            lang, text = (pa.chunked_array([k[j] for k in kept]) for j in (2, 3))
            kept.clear()
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, back, c)
            name = pc.binary_join_element_wise(lang.take(first), text.take(first), "\t").combine_chunks()
            order = pc.sort_indices(name)
            yield from _parts([name.take(order), pa.array(total).take(order)], ["name", "c"])

        held = 0
        for batch in batches:
            for data, offsets, langs, names in _slices(batch):
                words, lang_hash = _Words(data, offsets, langs), _lang_hash(names)
                all_names = pa.array(names, pa.string())
                seen = np.bincount(words.lang, minlength=len(names))
                there = np.flatnonzero(seen)
                kept.append(
                    (
                        mix(lang_hash[there]),
                        seen[there],
                        all_names.take(there),
                        pa.array([""] * len(there), pa.string()),
                    )
                )
                for size in sizes:
                    at, h = words.phrases(size, lang_hash)
                    hit = is_set(table.value, h & _KEY, twice=True)
                    at, h = at[hit], h[hit]
                    h, first, c = np.unique(h, return_index=True, return_counts=True)
                    at = at[first]
                    lang = all_names.take(words.lang[at])
                    kept.append((h, c, lang, words.spelled(at, size)))
                    held += len(h)
                if held >= GATHERED // 4:
                    yield from emit()
                    held = 0
        if kept:
            yield from emit()

    return run


def _frequent(texts: DataFrame, sizes: list[int], table, support: int, shards: int) -> DataFrame:
    """Keys that are frequent in a shard at its part of the support and may have the support in all.

    In a shard where a key is not frequent it has less than the lowered support, which bounds its sum.
    """
    counted = texts.mapInArrow(_mine(sizes, table, shards), _COUNTED)
    local = -(-support // shards)
    frequent = counted.groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= local)
    most = F.sum("c") + (F.lit(shards) - F.count(F.lit(1))) * (local - 1)
    h = F.col("key").bitwiseAND(F.lit(int(_KEY))).alias("h")
    return frequent.groupBy(h).agg(most.alias("most")).filter(F.col("most") >= support).select("h")


def frequent_phrases(
    docs: DataFrame,
    support: int = 10,
    longest: int = 3,
    shards: int = 2,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``c`` of every phrase of 1 to ``longest`` words with ``support`` occurrences.

    ``size`` 0 with an empty phrase counts all words of the language. The result is written to the shared folder.
    """
    if not 1 <= shards <= min(support, 127):
        raise ValueError("shards must be between 1 and the support, and below 128")
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    key = F.col("h")
    bits = bit_table(_frequent(texts, [1, 2] if longest > 1 else [1], None, support, shards), key, twice=True)
    for size in range(3, longest + 1):
        known = sc.broadcast(bits)
        bits = bits | bit_table(_frequent(texts, [size], known, support, shards), key, twice=True)
        known.destroy()
    known = sc.broadcast(bits)
    counted = texts.mapInArrow(_count(list(range(1, longest + 1)), known), _NAMED)
    total = counted.groupBy("name").agg(F.sum("c").alias("c"))
    lang = F.expr("left(name, length(name) - length(substring_index(name, '\t', -1)) - 1)")
    named = total.select(lang.alias("lang"), F.substring_index("name", "\t", -1).alias("phrase"), "c")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
    named = named.select("lang", size.alias("size"), "phrase", "c")
    out = cut_lineage(named.filter((F.col("c") >= support) | (F.col("size") == 0)))
    known.destroy()
    return out


def _joined_words(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _scored(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more with the score of their weakest cut."""
    parts = F.split("phrase", " ", -1)
    cut = (
        phrases.filter("size > 1")
        .withColumns({"words": parts, "cut": F.explode(F.expr("sequence(1, size - 1)"))})
        .select(
            "lang",
            "size",
            "phrase",
            F.col("c").alias("a"),
            "cut",
            _joined_words(F.col("words"), F.lit(1), F.col("cut")).alias("first"),
            _joined_words(F.col("words"), F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"),
        )
    )
    known = phrases.filter("size > 0")
    first = known.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"1000000BD * {wide.format('a')} * {wide.format('a')} div ({wide.format('l')} * {wide.format('r')})")
    least = F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r"))
    return (
        cut.join(first, ["lang", "first"])
        .join(rest, ["lang", "rest"])
        .groupBy("lang", "size", "phrase", "a")
        .agg(least.alias("x"))
        .select("lang", "size", "phrase", "a", "x.score", "x.l", "x.r")
    )


def _covering(phrases: DataFrame) -> DataFrame:
    """For phrases inside longer ones: ``longer``, the largest count of a longer phrase that holds them."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> "
        "transform(sequence(1, size - n + 1), at -> array_join(slice(words, at, n), ' '))))"
    )
    return (
        phrases.filter("size > 2")
        .withColumn("words", F.split("phrase", " ", -1))
        .select("lang", F.explode(inner).alias("phrase"), "c")
        .groupBy("lang", "phrase")
        .agg(F.max("c").alias("longer"))
    )


def collocations(
    docs: DataFrame,
    support: int = 10,
    longest: int = 3,
    covered: int = 50,
    top: int = 2000,
    shards: int = 2,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``top`` phrases of every language.

    Texts are lower-cased A-Z and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces
    and tabs. Candidates are phrases of 2 to ``longest`` words with ``a`` occurrences, ``support`` at least. The
    score is the least of ``floor(1000000 a a / (l r))`` over the cuts of a phrase into a first part with ``l``
    and a rest with ``r`` occurrences; equal scores take the earliest cut. A candidate inside a longer one that
    has ``covered`` per cent of its occurrences or more is left out. Order: score, then ``a``, falling, then the
    phrase. Scores are worked out in 38 decimal digits.

    Defined cases: a null or empty text has no words; a null language is ``und``, as a language of that name is.
    Repeated rows count each time; ids aren't read, so null and repeated ids change nothing. A text of any
    length is worked on in slices cut between pieces. A language without candidates has no rows, an empty table
    gives none, and other columns are ignored.
    """
    phrases = frequent_phrases(docs, support, longest, shards, text_col, lang_col)
    total = phrases.filter("size = 0").select("lang", F.col("c").alias("n"))
    scored = cut_lineage(
        _scored(phrases)
        .join(_covering(phrases), ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
        .drop("longer", "size")
    )
    # Scores are counted in steps, and only steps that reach the first `top` ranks are sorted.
    step = F.expr(f"score div {1000000 // _STEPS}")
    above = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    open_steps = steps.withColumn("before", F.coalesce(F.sum("rows").over(above), F.lit(0))).filter(F.col("before") < top)
    lowest = open_steps.groupBy("lang").agg(F.min("step").alias("lowest"))
    ranked = top_k(
        scored.join(lowest, "lang").filter(step >= F.col("lowest")).drop("lowest"),
        [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()],
        top,
        ["lang"],
    )
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
