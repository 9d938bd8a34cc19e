import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manualdex.llm import bit_table, phrases
from tests.llm import data

LANGS = [None, "en", "und", "de"]


def plain(rows, support, longest, covered, top):
    """(lang, rank) to (phrase, a, l, r, n, score), from counters over all pieces."""
    counts = {}
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(data.UPPER)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows_of = []
        for p, a in found.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, cut = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]], n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(rows_of)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


def frame(spark, rows):
    made = [(lang, text, 1, "x", 2.0, 3) for lang, text in rows]
    return spark.createDataFrame(made, "lang string, text string, rank int, phrase string, score double, c long")


def found(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("support, longest, covered, top, shards", [(10, 3, 50, 2000, 2), (4, 4, 70, 15, 3), (3, 2, 50, 9, 1)])
def test_collocations_match_plain_counts(spark, support, longest, covered, top, shards):
    rng = random.Random(support)
    words = [f"w{i}" for i in range(12)] + ["The", "ÉTÉ", "a b"]
    rows = []
    for i in range(300):
        parts = [rng.choice(words) + rng.choice([" ", " ", " \t ", ", ", "\r\n", ";"]) for _ in range(rng.randint(0, 40))]
        rows.append((LANGS[i % 4], "".join(parts) + rng.choice(["", "w0 w1 w2", "w0 w1 w2 w3."])))
    rows += [("en", None), (None, ""), ("de", " \t;;"), ("fr", "no phrase twice here")]
    got = found(phrases.collocations(frame(spark, rows).repartition(7), support, longest, covered, top, shards))
    assert got == plain(rows, support, longest, covered, top)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    long = " ".join(f"v{i % 701} x{i % 7}" + ("." if i % 50 == 0 else "") for i in range(300_000))
    unbroken = "q" * 10 + " ".join(f"u{i % 97}" for i in range(900_000))
    rows = [("en", long), ("de", unbroken), ("en", "Short one."), ("en", None)]
    got = found(phrases.collocations(frame(spark, rows), 10, 3, 50, 300))
    assert got == plain(rows, 10, 3, 50, 300)


def test_products_beyond_64_bits(spark):
    rows = [("en", 2, "a b", 3_000_000_000_000), ("en", 1, "a", 4_000_000_000_000), ("en", 1, "b", 5_000_000_000_000)]
    got = phrases._scored(spark.createDataFrame(rows, "lang string, size int, phrase string, c long")).collect()
    assert [(r.score, r.l, r.r) for r in got] == [(450_000, 4_000_000_000_000, 5_000_000_000_000)]


def test_empty_and_invalid(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(frame(spark, []), support=2, shards=3)


def test_bits_at_two_places_let_fewer_others_through(spark):
    rng = np.random.default_rng(4)
    held, others = rng.integers(0, 1 << bit_table.KEY_BITS, (2, 300_000))
    keys = spark.createDataFrame(pa.table({"h": held}))
    once = bit_table.bit_table(keys, F.col("h"))
    twice = bit_table.bit_table(keys, F.col("h"), twice=True)
    held, others = held.astype(np.uint64), others.astype(np.uint64)
    assert bit_table.is_set(twice, held, twice=True).all()
    assert bit_table.is_set(twice, others, twice=True).sum() < bit_table.is_set(once, others).sum() / 20


def test_phrases_that_share_a_mined_key_are_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_KEY", np.uint64(7))
    rng = random.Random(1)
    rows = [("en", " ".join(rng.choice("abcdefghij") for _ in range(60))) for _ in range(30)]
    assert found(phrases.collocations(frame(spark, rows), 10, 3, 50, 300)) == plain(rows, 10, 3, 50, 300)


def test_mined_rows_are_one_number_and_a_count(spark):
    texts = spark.createDataFrame([("en", "a b a b a b")], "lang string, text string")
    rows = texts.mapInArrow(phrases._mine([1, 2], None, 2), phrases._COUNTED)
    assert [t for _, t in rows.dtypes] == ["bigint", "bigint"]
    assert sorted(r.c for r in rows.collect()) == [2, 3, 3, 3] and all(r.key < 2 << 40 for r in rows.collect())
