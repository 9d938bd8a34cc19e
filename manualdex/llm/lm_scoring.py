"""Language-model scores by stupid backoff, computed relationally.

The model is a unigram and a bigram count table over the corpus. A word scores ln(c(v w) / c(v)) after the
word v if the bigram was seen at least ``min_count`` times, and else ln(``BACKOFF`` * c(w) / N). Written
as a sum that is a base for every word, which needs unigrams alone, plus a correction for every bigram that
was seen often enough:

    sum over words of ln(BACKOFF c(w) / N)  +  sum over seen bigrams of ln(c(v w) N / (BACKOFF c(v) c(w)))

so documents are exploded into bigrams once, dealt out by bigram, counted and corrected where they meet, and
summed by document.

Every word counts for itself. Words with at least ``SHARE`` of all words, at most 1 / SHARE of them, are broadcast
with their counts. A rarer word and every bigram with it are dealt out by the word's hash and meet there, so
its count and those of its bigrams are taken in one place, which holds less than SHARE of all words;
a bigram of two rare words goes to both. This table has no bound and grows with the corpus. Bigrams of the ``TOP``
most frequent words, at most TOP ** 2, are counted in the scan and broadcast too, so a bigram that is shuffled
has a word with less than 1 / TOP of all words, and no key is hot. All counts cover all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manualdex.llm import grams
from manualdex.session import cut_lineage

#: Factor of a step back from bigram to unigram.
BACKOFF = 0.4
#: Share of all words that a broadcast word has at least.
SHARE = 1e-6
#: Words, the unknown word among them, whose bigrams are counted in the scan.
TOP = 256
#: Distinct words a task counts before it hands its counts on.
HELD = 1 << 21
#: Bits of a word's number.
BITS = 20
#: Kinds of exploded rows, and what ``key`` and ``other`` hold in them. Rare words are hashes, known ones numbers.
TEXT = 0  # a text's sums: a random key; its number of words
WORD = 1  # a rare word: its hash; nothing
PAIR = 2  # a bigram of known words: both numbers; nothing
KNOWN_RARE, RARE_KNOWN = 3, 4  # a bigram with one rare word: its hash; the known word
SECOND, FIRST = 5, 6  # a bigram of rare words, once by each: the second's (first's) hash; that of the other


def _words(column: pa.Array) -> Iterator[tuple[int, int, grams.Words]]:
    for at, to, data, offsets in grams.slices(column):
        yield at, to, grams.words(data, offsets)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (64-bit hash), ``n``: how often each word occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

        keys, counts = [], []
        for batch in batches:
            for _, _, found in _words(batch.column(0)):
                unique, n = np.unique(found.hashes, return_counts=True)
                keys.append(unique)
                counts.append(n)
                if sum(map(len, keys)) > 2 * HELD:
                    merged, n = _sum(keys, counts)
                    if len(merged) > HELD:
                        yield handed(merged, n)
                        keys, counts = [], []
                    else:
                        keys, counts = [merged], [n]
        if keys:
            yield handed(*_sum(keys, counts))

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Unigrams:
    """The known words with counts, by falling count from number 1.

    Number 0 is a word that isn't known here: with ``fold`` all such are one unknown word, else each is a rare
    word with counts of its own, taken elsewhere.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, n_top: int = TOP, fold: bool = True):
        order = np.lexsort((words, -counts))
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(1, len(words) + 1)
        by_hash = np.argsort(words.view(np.uint64))
        self.hashes = words.view(np.uint64)[by_hash]
        self.numbers = numbers[by_hash]
        self.counts = np.concatenate(([total - counts.sum()], counts[order])).astype(float)
        self.total = total
        with np.errstate(divide="ignore"):
            self.log = np.log(self.counts)
        self.base = np.where(self.counts > 0, self.log - math.log(max(total, 1)), 0.0)
        self.fold = fold
        if not fold:
            self.base[0] = 0.0
        self.n_top = n_top
        self.top: np.ndarray | None = None

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def bigrams(self, found: grams.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words; for each pair of neighbours in a text its key and its text."""
        numbers, text = self.of(found.hashes), found.of_word()
        same = text[1:] == text[:-1]
        return numbers, ((numbers[:-1] << BITS) | numbers[1:])[same], text[1:][same]

    def rare(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the first, and the second, word of a bigram is a rare one."""
        if self.fold:
            return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        return keys >> BITS == 0, keys & ((1 << BITS) - 1) == 0

    def is_top(self, keys: np.ndarray) -> np.ndarray:
        first, second = self.rare(keys)
        return (keys >> BITS < self.n_top) & (keys & ((1 << BITS) - 1) < self.n_top) & ~first & ~second

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of top bigrams in the table of their counts."""
        return (keys >> BITS) * self.n_top + (keys & ((1 << BITS) - 1))

    def correction(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first, second = self.log[keys >> BITS], self.log[keys & ((1 << BITS) - 1)]
        return np.log(counts) - first - second + math.log(max(self.total, 1)) - math.log(BACKOFF)


def unigrams(counts: DataFrame, share: float = SHARE, n_top: int = TOP, fold: bool = True) -> Unigrams:
    """The known words of a ``word_counts`` table: at most 1 / ``share`` rows reach the driver."""
    if share * ((1 << BITS) - 1) < 1:
        raise ValueError(f"a share below {1 / ((1 << BITS) - 1)} has more words than numbers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(1, math.ceil(share * total))).toArrow()
    return Unigrams(found["word"].to_numpy(), found["n"].to_numpy(), int(total), n_top, fold)


def _top_counts(docs: DataFrame, model: Unigrams) -> np.ndarray:
    """Counts of the bigrams of the most frequent words, at the key's two numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = np.zeros(own.n_top**2, np.int64)
        for batch in batches:
            for _, _, found in _words(batch.column(0)):
                keys = own.bigrams(found)[1]
                keys = keys[own.is_top(keys)]
                table += np.bincount(own.place(keys), minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(model.n_top**2, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def backoff_scores(
    docs: DataFrame,
    min_count: int = 2,
    share: float | None = None,
    n_top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: float = SHARE,
) -> DataFrame:
    """One row per id: ``doc_id``, ``n_words``, ``n_seen`` (words scored by their bigram), ``score`` (sum of
    logarithms) and ``mean`` (per word). The first word of a text is scored without the backoff factor.

    Without ``share`` every word counts for itself, and ``known``, the share of a broadcast word, changes no
    result. With it, words with less than that share of all words count and score as one unknown word.

    Defined cases: null and empty texts have no words, score 0 and a null mean. Rows with one id, or
    without id, are scored as one document of several texts. An empty table gives no rows; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = share is not None
    model = unigrams(cut_lineage(word_counts(texts)), share if fold else known, n_top, fold)
    model.top = _top_counts(texts, model)
    shared = sc.broadcast(model)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a row of sums with a key of its own, and a row per bigram that isn't a top one."""
        own = shared.value
        for batch in batches:
            for at, to, found in _words(batch.column(1)):
                texts_here, starts = to - at, found.first[:-1]
                numbers, keys, text = own.bigrams(found)
                sizes = np.diff(found.first)
                base = np.bincount(found.of_word(), weights=own.base[numbers], minlength=texts_here)
                base += np.maximum(sizes - 1, 0) * math.log(BACKOFF)
                top = own.is_top(keys)
                counts = own.top[own.place(keys[top])]
                often = counts >= min_count
                add = own.correction(keys[top][often], counts[often])
                base += np.bincount(text[top][often], weights=add, minlength=texts_here)
                seen = np.bincount(text[top][often], minlength=texts_here)
                # The texts' rare words and other bigrams, each once with its number of times.
                first, second = own.rare(keys)
                same = found.of_word()
                same = same[1:] == same[:-1]
                before, after = found.hashes[:-1][same].view(np.int64), found.hashes[1:][same].view(np.int64)
                words, low = np.flatnonzero(numbers == 0) if not own.fold else np.empty(0, np.int64), (1 << BITS) - 1
                rows = [(WORD, found.hashes[words].view(np.int64), np.zeros(len(words), np.int64), found.of_word()[words])]
                for what, of, key, other in (
                    (PAIR, ~top & ~first & ~second, keys, np.zeros(len(keys), np.int64)),
                    (KNOWN_RARE, ~first & second, after, keys >> BITS),
                    (RARE_KNOWN, first & ~second, before, keys & low),
                    (SECOND, first & second, after, before),
                    (FIRST, first & second, before, after),
                ):
                    rows.append((what, key[of], other[of], text[of]))
                kinds = np.repeat(np.array([r[0] for r in rows], np.int8), [len(r[1]) for r in rows])
                key, other, of_text = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
                order = np.lexsort((other, key, kinds, of_text))
                kinds, key, other, of_text = kinds[order], key[order], other[order], of_text[order]
                new = np.ones(len(key), bool)
                new[1:] = (
                    (key[1:] != key[:-1])
                    | (other[1:] != other[:-1])
                    | (kinds[1:] != kinds[:-1])
                    | (of_text[1:] != of_text[:-1])
                )
                places = np.flatnonzero(new)
                times = np.diff(np.append(places, len(key)))
                m = len(places)
                which = np.concatenate((np.arange(texts_here), of_text[places]))
                # Keys spread at random for the rows of texts.
                apart = grams.mix((starts + at).astype(np.uint64) * grams.U(len(numbers) + 1)) >> grams.U(20)
                none = np.arange(texts_here + m) >= texts_here
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((np.full(texts_here, TEXT, np.int8), kinds[places]))),
                        pa.array(np.concatenate((apart.astype(np.int64), key[places]))),
                        pa.array(np.concatenate((sizes.astype(np.int64), other[places]))),
                        batch.column(0).take(pa.array(at + which)),
                        pa.array(np.concatenate((seen, times)).astype(np.int32)),
                        pa.array(np.concatenate((base, np.zeros(m))), mask=none),
                    ],
                    ["kind", "key", "other", "doc_id", "times", "base"],
                )

    doc_type = texts.schema["doc_id"].dataType.simpleString()
    exploded = texts.mapInArrow(
        explode, f"kind byte, key long, other long, doc_id {doc_type}, times int, base double"
    )
    # The known words' logarithms come back as columns by a join on its two bounded sides.
    logs = docs.sparkSession.createDataFrame(
        pa.table({"number": np.arange(len(model.log)), "log": np.where(np.isfinite(model.log), model.log, 0.0)})
    )
    kind = F.col("kind")
    # Dealt and sorted once for both windows.
    met = exploded.repartition("key").sortWithinPartitions("key", "kind", "other")
    counted = met.withColumn("count", F.sum("times").over(Window.partitionBy("key", "kind", "other")))
    if not fold:
        of_word = F.sum(F.when(kind == WORD, F.col("times"))).over(Window.partitionBy("key"))
        counted = counted.withColumn("of_word", of_word)
    counted = counted.filter(kind.isin(TEXT, WORD) | (F.col("count") >= min_count))
    first, second = logs.toDF("first", "log_first"), logs.toDF("second", "log_second")
    counted = (
        counted.withColumns(
            {
                "first": F.when(kind == PAIR, F.shiftright("key", BITS)).when(kind == KNOWN_RARE, F.col("other")),
                "second": F.when(kind == PAIR, F.col("key").bitwiseAND((1 << BITS) - 1)).when(
                    kind == RARE_KNOWN, F.col("other")
                ),
            }
        )
        .join(F.broadcast(first), "first", "left")
        .join(F.broadcast(second), "second", "left")
    )
    all_words = math.log(max(model.total, 1))
    times, zero = F.col("times"), F.lit(0.0)
    own = zero if fold else F.log(F.col("of_word").cast("double"))
    gain = F.log(F.col("count").cast("double")) + F.lit(all_words - math.log(BACKOFF))
    gain = gain - F.coalesce("log_first", zero) - F.coalesce("log_second", zero)
    value = (
        F.when(kind == TEXT, F.col("base"))
        .when(kind == WORD, times * (own - F.lit(all_words)))
        .when(kind == PAIR, times * gain)
        .when(kind == FIRST, -times * own)
        .otherwise(times * (gain - own))
    )
    return (
        counted.groupBy("doc_id")
        .agg(
            F.sum(F.when(kind == TEXT, F.col("other"))).alias("n_words"),
            F.sum(F.when(kind.isin(WORD, FIRST), 0).otherwise(times).cast("long")).alias("n_seen"),
            F.sum(value).alias("score"),
        )
        .withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
    )
