"""Spelling variants: pairs of words one edit apart, found by a relational frontier over two tries.

Words are paths from the root of a trie; a node is known by the hash of the path to it, so the trie is a plain
table of edges. Of two words one edit apart, either the first halves are equal or the second halves
are, so a trie of the words and one of the reversed words are walked, and edits are tried only below
the middle, where few words share a node.

A state is (word, node reached, place in the word, edits). States without an edit are the word's own nodes.
The first join makes the edit: from a node it passes over one character of an edge, which either stands
for the word's next character (replaced) or is extra (inserted), and requires the edge after it to carry the
next ``STRIDE`` characters of the word (all the rest of a word over ``LONG``). Each further level joins the states with the nodes reached over the
next characters, twice as many as before, so that a word of length n takes about log(n) levels; a state
whose path ends with its word is a neighbour. Deletions are insertions seen from the other word. All
neighbours are confirmed by their edit distance, so a clash of hashes can't add a pair; equal paths have
equal hashes, so none is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manualdex.llm.grams import LOWER, U, mix
from manualdex.llm.rolling import Stretches, joined, ragged
from manualdex.session import cut_lineage

#: Characters that the edge after an edit carries.
STRIDE = 3
#: Words longer than this take all the rest as one edge, so that no state carries a long word along.
LONG = 64
#: Distinct words that a task gathers before it emits their counts.
GATHERED = 1 << 19
#: Characters of words worked on at once.
SLICE = 1 << 19

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_rng = np.random.Generator(np.random.PCG64(11))
#: Codes of characters in the trie of words and in that of reversed words; 0x110000 ends a word.
_CODES = _rng.integers(1, 1 << 63, (2, 0x110001), dtype=np.uint64)
_END = 0x110000


def _counts(every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc.as_py()}:".encode()) if doc.is_valid else None
                # A long text is taken in stretches that end between runs.
                for found in _stretches(text.as_py() or ""):
                    if start is not None:
                        for run in [r for r in found if zlib.crc32(r.encode(), start) % every == 0]:
                            at = zlib.crc32(run.encode(), start) % len(run)
                            total[run[:at] + run[at + 1 :]] += found.pop(run)
                    total.update(found)
                if len(total) >= GATHERED:
                    yield emit()
        yield emit()

    return run


def _stretches(text: str) -> Iterator[Counter]:
    at = 0
    while at < len(text):
        to = at + (1 << 20)
        while to < len(text) and _RUN.match(text, to):
            to += 1
        yield Counter(_RUN.findall(text[at:to].translate(_LOWER)))
        at = to


def words(
    docs: DataFrame,
    min_length: int = 5,
    min_count: int = 3,
    every: int = 97,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word``, ``n`` of all words of ``min_length`` code points that occur ``min_count`` times, after deletions.

    Words are runs of letters, lower-cased A-Z. Where ``every`` divides the crc32 of ``<id>:<run>``, one code point of
    the run goes. A row without id deletes nothing.
    """
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    counted = texts.mapInArrow(_counts(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _groups(strings: list[str]) -> Iterator[list[str]]:
    """Words in order, about ``SLICE`` characters at once."""
    held, size = [], 0
    for s in strings:
        if held and size + len(s) > SLICE:
            yield held
            held, size = [], 0
        held.append(s)
        size += len(s)
    if held:
        yield held


class _Paths:
    """Words as code sequences, each followed by the end code, in one direction."""

    def __init__(self, strings: list[str], way: int) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        chars = np.full(int(self.lengths.sum()) + len(strings), _END, np.int64)
        inside = np.ones(len(chars), bool)
        inside[self.first + self.lengths] = False
        text = "".join(s[::-1] if way else s for s in strings)
        chars[inside] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars = chars
        self.hash = Stretches(_CODES[way][chars])

    def stretch(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial of the characters a to b of words w; the end code is the last character there is."""
        last = self.lengths[w] + 1
        return self.hash.raw(self.first[w] + np.minimum(a, last), self.first[w] + np.minimum(b, last))


def _key(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    return mix(mix(node) + label * U(0x9E3779B97F4A7C15))


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    def column(v: np.ndarray | pa.Array) -> pa.Array:
        if isinstance(v, np.ndarray):
            return pa.array(v.view(np.int64) if v.dtype == np.uint64 else v)
        return v

    return pa.RecordBatch.from_arrays([column(v) for v in columns.values()], list(columns))


def _labels(p: _Paths, w: np.ndarray, whole: bool) -> np.ndarray:
    """Characters that the edge after an edit carries: the next ones, or all the rest of a long word."""
    return p.lengths[w] + 1 if whole else np.full(len(w), STRIDE)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges below the middle: from a node over one character, then over the next ones, to the node reached."""
    for batch in batches:
        for group in _groups(batch.column(0).to_pylist()):
            for way in (0, 1):
                for whole in (False, True):
                    # Words around the bound have both kinds, as a neighbour may be on its other side.
                    p = _Paths([g for g in group if (len(g) >= LONG if whole else len(g) <= LONG + 1)], way)
                    half = (p.lengths - 1) // 2
                    w, k = ragged(p.lengths - half)
                    at = k + half[w]
                    node = p.stretch(w, np.zeros_like(at), at)
                    depth = np.minimum(at + 1 + _labels(p, w, whole), p.lengths[w] + 1)
                    label = p.stretch(w, at + 1, depth)
                    over = p.chars[p.first[w] + at].astype(np.int32)
                    reached = p.stretch(w, np.zeros_like(at), depth)
                    yield _batch(
                        {"key": _key(node, label), "over": over, "reached": reached, "depth": depth.astype(np.int32)}
                    )


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word's own nodes from the middle on, once for a replaced and once for an inserted character."""
    for batch in batches:
        for group in _groups(batch.column(0).to_pylist()):
            for way, inserted, whole in np.ndindex(2, 2, 2):
                part = [g for g in group if (len(g) > LONG) == bool(whole)]
                p, me = _Paths(part, way), _Paths(part, 0)
                me = me.stretch(np.arange(len(part)), np.zeros(len(part), np.int64), me.lengths + 1)
                half = p.lengths // 2
                w, k = ragged(p.lengths - half + inserted)
                at = k + half[w]
                after = at + 1 - inserted
                node = p.stretch(w, np.zeros_like(at), at)
                place = np.minimum(after + _labels(p, w, bool(whole)), p.lengths[w] + 1)
                label = p.stretch(w, after, place)
                strings = pa.nulls(len(w), pa.string()) if whole else pa.array(part, pa.string()).take(pa.array(w))
                yield _batch(
                    {
                        "key": _key(node, label),
                        "own": p.chars[p.first[w] + at].astype(np.int32),
                        "me": me[w],
                        "word": strings,
                        "way": np.full(len(w), way, np.int32),
                        "place": place.astype(np.int32),
                        "done": place > p.lengths[w],
                    }
                )


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes below the middle."""
    for batch in batches:
        for group in _groups(batch.column(0).to_pylist()):
            for way in (0, 1):
                p = _Paths(group, way)
                half = (p.lengths - 1) // 2
                w, k = ragged(p.lengths + 1 - half)
                at = k + 1 + half[w]
                yield _batch({"reached": p.stretch(w, np.zeros_like(at), at)})


def _further(stride: int) -> Callable:
    """States moved on by up to ``stride`` characters of their word; those at its end are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            strings = columns["word"].to_pylist()
            at = 0
            for group in _groups(strings):
                part = {k: v.slice(at, len(group)) for k, v in columns.items()}
                at += len(group)
                numbers = {k: part[k].to_numpy(zero_copy_only=False) for k in ("reached", "depth", "way", "place")}
                out = {k: numbers[k].copy() for k in ("reached", "depth", "place")}
                for way in (0, 1):
                    mine = np.flatnonzero(numbers["way"] == way)
                    if not len(mine):
                        continue
                    p = _Paths([group[i] for i in mine], way)
                    w = np.arange(len(mine))
                    place = numbers["place"][mine].astype(np.int64)
                    depth = numbers["depth"][mine].astype(np.int64)
                    to = np.minimum(place + stride, p.lengths + 1)
                    more = p.stretch(w, place, to)
                    raw = numbers["reached"][mine].astype(np.int64).view(np.uint64)
                    out["reached"][mine] = joined(raw, depth, more).view(np.int64)
                    out["depth"][mine] = depth + to - place
                    out["place"][mine] = to
                yield _batch(
                    {
                        "me": part["me"],
                        "word": part["word"],
                        "way": part["way"],
                        "reached": out["reached"],
                        "depth": out["depth"].astype(np.int32),
                        "place": out["place"].astype(np.int32),
                        "done": np.array([p > len(g) for p, g in zip(out["place"], group)]),
                    }
                )

    return run


_STATE = "me long, word string, way int, reached long, depth int, place int, done boolean"
_COLUMNS = ["me", "word", "way", "reached", "depth", "place", "done"]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last node of every word in both tries."""
    for batch in batches:
        for group in _groups(batch.column(0).to_pylist()):
            for way in (0, 1):
                p = _Paths(group, way)
                w = np.arange(len(group))
                yield _batch(
                    {
                        "reached": p.stretch(w, w * 0, p.lengths + 1),
                        "near": pa.array(group, pa.string()),
                        "way": np.full(len(group), way, np.int32),
                    }
                )


def _meet(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by shuffle, never by a broadcast.

    Spark sizes a table by its file and columns: rows that a task makes of a word, and packed files, are many times
    what it takes them for, so both sides could be sent to the driver.
    """
    return left.join(right.hint("merge"), key, how)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """All pairs ``word``, ``near`` of distinct words of ``vocabulary`` (``word``) exactly one edit apart, both ways round."""
    only = vocabulary.select("word")
    longest = only.filter(F.length("word") <= LONG).agg(F.max(F.length("word"))).first()[0] or 0
    edges = only.mapInArrow(_edges, "key long, over int, reached long, depth int").distinct()
    states = only.mapInArrow(
        _states, "key long, own int, me long, word string, way int, place int, done boolean"
    )
    live = cut_lineage(_meet(states, edges, "key").filter("own <> over").select(*_COLUMNS))
    finished = live.filter("done").select("me", "reached")
    stride, walked = STRIDE, STRIDE
    while walked <= longest - longest // 2:
        stride, walked = 2 * stride, walked + 2 * stride
        nodes = only.mapInArrow(_nodes, "reached long").distinct()
        moved = live.filter("NOT done").mapInArrow(_further(stride), _STATE)
        live = cut_lineage(_meet(moved, nodes, "reached", "left_semi").select(*_COLUMNS))
        finished = finished.union(live.filter("done").select("me", "reached"))
    ends = cut_lineage(only.mapInArrow(_ends, "reached long, near string, way int"))
    own = ends.filter("way = 0").select(F.col("reached").alias("me"), F.col("near").alias("word"))
    pairs = _meet(_meet(finished.distinct(), ends.drop("way"), "reached"), own, "me").select("word", "near")
    confirmed = pairs.filter(F.levenshtein("word", "near", 1) == 1)
    return confirmed.union(confirmed.select("near", "word")).distinct()


def variants(
    docs: DataFrame,
    min_length: int = 5,
    min_count: int = 3,
    every: int = 97,
    ratio: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of ``words``. Two are near if exactly one code point is inserted, deleted or replaced between
    them. A word's form is its near word of largest ``n``, the smallest in code-point order of several,
    if that ``n`` is ``ratio`` times its own or more; its root is where the forms lead to.

    Defined cases: a null or empty text has no words; a row without id deletes no code points; repeated rows count each
    time. Letters outside A-Z keep their case. Words of any length are handled, their walk takes about
    log(length) levels. An empty table gives no rows; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could lead in circles")
    vocabulary = cut_lineage(words(docs, min_length, min_count, every, id_col, text_col))
    pairs = _meet(neighbours(vocabulary), vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    # Of equal counts the smallest word: order by -m, then by the word's bytes, which is code-point order.
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    kept = cut_lineage(
        _meet(vocabulary, best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
            F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")).alias("form_n"),
        )
    )
    return _meet(kept, _roots(kept), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(kept: DataFrame) -> DataFrame:
    """``word``, ``root`` of all words with a form, by doubling the step along the forms.

    Each form is at least twice as frequent, so no chain has more than 63 steps.
    """
    steps = kept.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut_lineage(
            _meet(steps, ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        if steps.filter("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")
