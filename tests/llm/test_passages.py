import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from manualdex.llm import passages


def plain(texts, length):
    """Of every text (bytes, removed, runs, rest), from counts of all its windows."""
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(np.int8)) == 1).sum() + (len(b) > 0 and gone[0]))
        rest = np.frombuffer(b, np.uint8)[~gone[: len(b)]].tobytes()
        out.append((len(b), int(gone[: len(b)].sum()), runs, rest))
    return out


def check(spark, rows, length):
    made = [(i, t, 1, "row", "id", "spans", 4) for i, t in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, s int, row string, id string, spans string, e int")
    got = passages.remove_repeats(docs.repartition(5), length).collect()
    want = [(i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], length))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    mine = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got)


def corpus(seed, n=120):
    rng = random.Random(seed)
    letters = "abcdefgh éß\n𝄞"
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(60, 900))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) - 1)
            parts.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))]))
        rows.append((rng.choice([i, i, None, 3]), "".join(parts)))
    own = "".join(rng.choice(letters) for _ in range(500))
    return rows + [(1, None), (2, ""), (4, "ab" * 3000), (5, "a" * 700), (6, own + own), (7, own[:100]), (8, shared[0]), (8, shared[0])]


@pytest.mark.parametrize("seed, length", [(1, 64), (2, 100), (3, 400)])
def test_repeats_match_counts_of_all_windows(spark, seed, length):
    check(spark, corpus(seed), length)


@pytest.mark.parametrize("limit, blocks", [(2000, (64, 8, 1)), (0, (16, 1)), (0, (1,))])
def test_keys_beyond_the_limit(spark, monkeypatch, limit, blocks):
    monkeypatch.setattr(passages, "LIMIT", limit)
    monkeypatch.setattr(passages, "BLOCKS", blocks)
    rng = random.Random(limit)
    passage = "".join(rng.choice("klmnopq ") for _ in range(400))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(60)) + passage + "".join(rng.choice("uvw") for _ in range(60))) for i in range(60)]
    check(spark, rows + corpus(4, 40), 100)


def test_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(700_000))
    check(spark, [(1, long), (2, "x" + long[600_000:] + "y" + long[:300]), (3, long[524_000:524_600])], 400)


def test_boundaries_are_common_prefixes():
    rng = random.Random(6)
    for letters, length in (("ab", 3), ("abc", 70), ("a", 9)):
        text = np.frombuffer("".join(rng.choice(letters) for _ in range(300)).encode() * 2 + b"\xfe", np.uint8)
        order = passages.suffix_order(text)
        suffixes = [text[i:].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        open_ = passages.open_boundaries(text[order - 1], length)
        want = [a[:length] == b[:length] and len(b) >= length for a, b in zip(suffixes, suffixes[1:])]
        assert open_[1:-1].tolist() == want and not open_[0] and not open_[-1]


def test_empty_and_invalid(spark):
    check(spark, [(1, "short")], 64)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        passages.remove_repeats(empty, 63)


def test_a_block_of_a_key_beyond_the_limit_is_one_row(spark, monkeypatch):
    monkeypatch.setattr(passages, "LIMIT", 0)
    rng = random.Random(7)
    core = "".join(rng.choice("abcdefgh") for _ in range(100))
    texts = [(core[:50] + rng.choice("xyz") + core[50:] + "".join(rng.choice("abcdefgh") for _ in range(30))).encode() for _ in range(40)]
    rows = [(1, i, 1, bytearray(t)) for i, t in enumerate(texts)]
    units = spark.createDataFrame(rows, "key long, content long, n long, text binary")
    found = passages._hot_found(units, 64, (16, 1)).collect()
    # A window is a row of its own on the last level, but its block comes back as one row with few spans.
    cut = units.mapInArrow(passages._blocks(64, 16), passages._BLOCK)
    assert 0 < len(found) <= cut.count()
    assert all(x.b < y.a for r in found for x, y in zip(r.spans, r.spans[1:]))
    seen = Counter(t[i : i + 64] for t in texts for i in range(len(t) - 63))
    want = {(i, at) for i, t in enumerate(texts) for at in range(len(t) - 63) if seen[t[at : at + 64]] > 1}
    assert {(r.content, at) for r in found for s in r.spans for at in range(s.a, s.b)} == want
