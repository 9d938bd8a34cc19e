import random
import re
import zlib
from collections import Counter

import pytest

from manualdex.llm import spelling
from tests.llm import data


def distance_is_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain(rows, min_length, min_count, every, ratio):
    """The rows of ``variants``, by comparing all pairs of words."""
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(data.UPPER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in known if distance_is_one(w, v)] for w in known}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        if best and known[best] >= ratio * known[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), known[w], len(near[w]), known.get(form.get(w))) for w in known}


def frame(spark, rows):
    made = [(i, t, 1, "w", "r", 5, 0) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, n int, word string, root string, form int, place int")


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("min_length, min_count, every", [(5, 3, 97), (1, 1, 3), (2, 2, 97)])
def test_variants_match_all_pairs(spark, min_length, min_count, every):
    rng = random.Random(min_length)
    bases = ["".join(rng.choice("abcdeÉñ÷") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = list(rng.choice(bases[: rng.randint(1, 60)]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "É", "aa"])
            words.append("".join(w))
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ", "-", "1", "ß "]).join(words)))
    rows += [(1, None), (2, ""), (3, "123 --"), (4, "aaaaa aaaaaa aaaaaaa " * 3)]
    got = found(spelling.variants(frame(spark, rows), min_length, min_count, every))
    assert got == plain(rows, min_length, min_count, every, 2)


def test_long_words_and_chains(spark):
    long = "".join(f"q{'abcdefghij'[i % 10]}" for i in range(20_000))
    end = long + "x"
    other = "z" + long[1:]
    middle = long[:20_000] + "k" + long[20_000:]
    chain = [("chains", 16), ("chainx", 8), ("chaixx", 4), ("chayxx", 2)]
    text = " ".join([long] * 4 + [end] * 2 + [other] * 2 + [middle] * 2 + [w for w, n in chain for _ in range(n)])
    rows = [(None, text)]
    got = found(spelling.variants(frame(spark, rows), 5, 2))
    assert got == plain(rows, 5, 2, 97, 2)
    assert got["chayxx"][:2] == ("chaixx", "chains") and got[end][:2] == (long, long)


def test_runs_across_long_texts(spark):
    text = "word " * 250_000 + "straße"
    rows = [(5, text), (5, text)]
    assert found(spelling.variants(frame(spark, rows), 4, 2)) == plain(rows, 4, 2, 97, 2)


def test_empty_and_invalid(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, "lonely"), (2, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, []), ratio=1)


def test_no_table_of_the_words_is_broadcast(spark, monkeypatch):
    """Spark takes the tables made of the words for small ones; no join may rest on that."""
    plans, cut = [], spelling.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df)

    monkeypatch.setattr(spelling, "cut_lineage", seen)
    rows = [(i, "spelling speling spellings " * (3 if i else 1)) for i in range(3)]
    out = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().toString())
    assert {r["word"]: r["n_near"] for r in out.collect()} == {"spelling": 2, "speling": 1, "spellings": 1}
    assert sum("Join" in p for p in plans) > 3 and not [p for p in plans if "BroadcastHashJoin" in p]
