"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: how often each byte follows each context of 0 to 3 bytes. A byte's
exact code length under frozen counts is -log2 of its share in the longest context that was seen with
it, plus the escapes on the way down (method C: a context with d different followers and n in all
gives each follower c / (n + d) and the escape d / (n + d)); a byte never seen costs 8 bits after the last
escape. The language with the shortest code wins, and its score is its share of the probability that
the codes give.

Counting 4-byte strings is enough, as shorter contexts are their sums. Spark counts them over a
sample of labelled documents and adds them up by language; the driver turns the sums into tables of
code lengths and broadcasts those. A text is scored where it is read: its 4-byte strings are looked up
all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manualdex.llm import grams

#: Labelled documents of each language that are learned from, about: the bound of the sample.
SAMPLE = 3000
#: Context before the first byte of a text.
START = "\n\n\n"
#: Bytes scored at once, times languages.
BLOCK = 1 << 22
#: Pairs of byte pairs that the direct index may have.
DIRECT = 1 << 24

#: A-Z as a-z and all digits as one.
FOLD = grams.LOWER.copy()
FOLD[48:58] = 48


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=values, minlength=len(unique))


def _order(strings: np.ndarray, counts: np.ndarray):
    """For strings of one length: code lengths of the last byte, the contexts, their escapes' lengths."""
    context, at = np.unique(strings >> 8, return_inverse=True)
    total = np.bincount(at, weights=counts)
    different = np.bincount(at)
    code = np.log2((total + different)[at] / counts)
    return code, context, np.log2((total + different) / different)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys, 0 where unknown, and which are known."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return np.where(known, values[at], 0.0), known


class Model:
    """Tables of code lengths of all languages under frozen counts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: by language, 4-byte strings as integers and how often each occurs."""
        self.languages = sorted(counts)
        n = len(self.languages)
        fours = {l: _sums(*counts[l]) for l in self.languages}
        threes = {l: _sums(g & 0xFFFFFF, c) for l, (g, c) in fours.items()}
        self.u4 = np.unique(np.concatenate([g for g, _ in fours.values()])) if n else np.empty(0, np.int64)
        self.u3 = np.unique(np.concatenate([self.u4 & 0xFFFFFF, self.u4 >> 8]))
        self.c4 = np.empty((len(self.u4) + 1, n), np.float32)
        self.c3 = np.empty((len(self.u3), n), np.float32)
        self.e3 = np.empty((len(self.u3), n), np.float32)
        self.c2 = np.empty((65536, n), np.float32)
        self.e2 = np.empty((65536, n), np.float32)
        pairs = np.arange(65536)
        for k, l in enumerate(self.languages):
            g4, n4 = fours[l]
            g3, n3 = threes[l]
            g2, n2 = _sums(g3 & 0xFFFF, n3)
            g1, n1 = _sums(g2 & 0xFF, n2)
            code, _, escape = _order(g1, n1)
            c1, known = _looked_up(g1, code, np.arange(256))
            c1 = np.where(known, c1, escape[0] + 8)
            code, context, escape = _order(g2, n2)
            c2, known = _looked_up(g2, code, pairs)
            c2 = np.where(known, c2, _looked_up(context, escape, pairs >> 8)[0] + c1[pairs & 0xFF])
            code, context, escape = _order(g3, n3)
            e2 = _looked_up(context, escape, pairs)[0]
            c3, known = _looked_up(g3, code, self.u3)
            c3 = np.where(known, c3, e2[self.u3 >> 8] + c2[self.u3 & 0xFFFF])
            code, context, escape = _order(g4, n4)
            e3 = _looked_up(context, escape, self.u3)[0]
            c4, known = _looked_up(g4, code, self.u4)
            below = e3[np.searchsorted(self.u3, self.u4 >> 8)] + c3[np.searchsorted(self.u3, self.u4 & 0xFFFFFF)]
            self.c4[:-1, k] = np.where(known, c4, below)
            self.c3[:, k], self.e3[:, k], self.c2[:, k], self.e2[:, k] = c3, e3, c2, e2
        self.c4[-1] = 0
        # Direct index: pair numbers of the first and the last two bytes give the row of c4.
        seen = np.unique(np.concatenate([self.u4 >> 16, self.u4 & 0xFFFF]))
        self.width = len(seen) + 1
        self.direct = None
        if self.width**2 <= DIRECT:
            self.pair = np.zeros(65536, np.int32)
            self.pair[seen] = np.arange(1, self.width)
            self.direct = np.full(self.width**2, len(self.u4), np.int32)
            self.direct[self.pair[self.u4 >> 16] * self.width + self.pair[self.u4 & 0xFFFF]] = np.arange(len(self.u4))

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths in bits, (texts, languages), of texts that each follow ``START`` in ``data``."""
        texts = len(ends) - 1
        out = np.zeros((texts, len(self.languages)))
        step = max(1 << 12, BLOCK // max(1, len(self.languages)))
        folded = FOLD[data]
        for at in range(0, len(folded) - 3, step):
            part = folded[at : at + step + 3].astype(np.int32)
            pairs = (part[:-1] << 8) | part[1:]
            rows = self._rows(pairs)
            bits = self.c4[rows]
            odd = np.flatnonzero(rows == len(self.u4))
            if len(odd):
                bits[odd] = self._shorter(pairs[odd], pairs[odd + 1], pairs[odd + 2])
            # Strings that begin in the last three bytes of a text reach into the next one.
            starts = ends[:-1] - at
            stops = ends[1:] - 3 - at
            first = np.clip(starts, 0, len(bits))
            last = np.clip(stops, 0, len(bits))
            total = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
            full = last > first
            out[full] += total[last[full]] - total[first[full]]
        return out

    def _rows(self, pairs: np.ndarray) -> np.ndarray:
        if self.direct is not None:
            numbers = self.pair[pairs]
            return self.direct[numbers[:-2] * self.width + numbers[2:]]
        wanted = (pairs[:-2].astype(np.int64) << 16) | pairs[2:]
        at = np.minimum(np.searchsorted(self.u4, wanted), len(self.u4) - 1)
        return np.where(self.u4[at] == wanted, at, len(self.u4))

    def _shorter(self, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Code lengths of strings that no language has seen in full, from their three byte pairs."""
        context = (first.astype(np.int64) << 8) | (middle & 0xFF)
        rest = (middle.astype(np.int64) << 8) | (last & 0xFF)
        at = np.minimum(np.searchsorted(self.u3, context), len(self.u3) - 1)
        bits = np.where((self.u3[at] == context)[:, None], self.e3[at], 0)
        at = np.minimum(np.searchsorted(self.u3, rest), len(self.u3) - 1)
        return bits + np.where((self.u3[at] == rest)[:, None], self.c3[at], self.e2[middle] + self.c2[last])


def _after_start(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = pc.binary_join_element_wise(
        pa.scalar(START), texts.fill_null("").cast(pa.large_string()), pa.scalar(""), null_handling="replace"
    ) if texts.type == pa.large_string() else pc.binary_join_element_wise(pa.scalar(START), texts.fill_null(""), "")
    return grams.slices(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), object)
        for language in sorted(set(languages.tolist())):
            texts = batch.column(1).filter(pa.array(languages == language))
            for _, _, data, ends in _after_start(texts):
                b = FOLD[data].astype(np.int64)
                strings = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                inside = np.ones(len(strings), bool)
                for back in (1, 2, 3):
                    cross = ends[1:-1] - back
                    inside[cross[cross < len(inside)]] = False
                found, counts = np.unique(strings[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(found), pa.string()), pa.array(found), pa.array(counts)],
                    ["lang", "string", "n"],
                )


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labelled`` (``id``, ``text``, ``lang``), at most about ``sample`` documents a language.

    Which documents are sampled depends on a hash of the id alone. Rows without text or language are
    left out. The tables that reach the driver are bounded by the sample.
    """
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    rate = F.create_map(*[F.lit(x) for l, n in sorted(sizes.items()) for x in (l, min(1.0, sample / n))])
    chosen = usable.filter(F.xxhash64("id") / F.lit(2.0**64) + 0.5 < rate[F.col("lang")])
    # A language whose few documents all miss the sample is learned from all of them.
    counts = _counted(chosen)
    missing = [l for l in sizes if l not in counts]
    if missing:
        counts |= _counted(usable.filter(F.col("lang").isin(missing)))
    return Model(counts)


def _counted(labelled: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rows = (
        labelled.select("lang", "text")
        .mapInArrow(_count, "lang string, string long, n long")
        .groupBy("lang", "string")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = np.array(rows["lang"].to_pylist(), object)
    strings, counts = rows["string"].to_numpy(), rows["n"].to_numpy().astype(float)
    return {l: (strings[languages == l], counts[languages == l]) for l in set(languages.tolist())}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang_pred``, ``score``, ``bits_per_byte``.

    ``score`` is the share of the best language in 2 ** -code length over all languages.

    Defined cases: a null text, a text without any letter and every text under a model without
    languages is ``und`` with score 0 and null ``bits_per_byte``. Of equal code lengths the language
    that sorts first wins. Repeated rows are scored each, null ids stay null, an empty table gives no rows,
    other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names: list = []
            scores, rates = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for at, to, data, ends in _after_start(batch.column(1)):
                if not own.languages:
                    names += [None] * (to - at)
                    continue
                bits = own.lengths(data, ends)
                best = bits.argmin(1)
                low = bits[np.arange(to - at), best]
                names += [own.languages[b] for b in best]
                scores[at:to] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                rates[at:to] = low / np.maximum(np.diff(ends) - 3, 1)
            none = ~letters if own.languages else np.ones(batch.num_rows, bool)
            found = pa.array(["und" if x else l for x, l in zip(none, names)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    found,
                    pa.array(np.where(none, 0.0, scores)),
                    pa.array(rates, pa.float64(), mask=none),
                ],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
