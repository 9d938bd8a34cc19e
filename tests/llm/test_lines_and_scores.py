import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from manualdex.llm import line_dedup, lm_scoring, queries
from tests.llm import data


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, text, times):
    chars = list(text)
    for _ in range(times):
        kind, at = rng.randrange(3), rng.randrange(len(chars))
        if kind == 0:
            chars[at] = rng.choice("abcé")
        elif kind == 1:
            chars.insert(at, rng.choice("abcé"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "a"), ("a", ""), ("abc", "abcabc")]
    for _ in range(150):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 70)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("w")).collect()
    assert all(r.w == (distance(r.a, r.b) <= threshold) for r in got)


def test_probes_of_a_threshold():
    assert line_dedup.places(1) == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 1)]
    assert len(line_dedup.places(2)) == 12


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_classes_match_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randint(10, 40))).strip() or "x" for _ in range(25)]
    docs = [
        (d, "\n".join([edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))] + [" ", "ab"]), "en", "a")
        for d in range(60)
    ]
    docs += [(90, None, "en", "a"), (91, "", "en", "a"), (92, "\n\n \t", "en", "a"), (93, base[0] + "\r\n" + base[0], "en", "a")]
    every = [(d, i, x.strip(" \t\r")) for d, t, *_ in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")]
    parent = {x: x for *_, x in every}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unique = sorted(parent)
    for i, a in enumerate(unique):
        for b in unique[:i]:
            if min(len(a), len(b)) > threshold and abs(len(a) - len(b)) <= threshold:
                if distance(a, b) <= threshold:
                    parent[root(a)] = root(b)
    head = {}
    for d, i, x in sorted(every):
        head.setdefault(root(x), (d, i))
    got = line_dedup.line_classes(data.documents(spark, docs), threshold).collect()
    assert {(r.doc_id, r.place): (r.first_doc, r.first_place, r.kept) for r in got} == {
        (d, i): (*head[root(x)], head[root(x)] == (d, i)) for d, i, x in every
    }
    by_doc = {r.doc_id: r for r in line_dedup.deduplicated(data.documents(spark, docs), threshold).collect()}
    assert by_doc[93].n_lines == 2 and by_doc[93].n_dropped >= 1 and not {90, 91, 92} & by_doc.keys()


def test_lines_of_awkward_rows(spark):
    got = line_dedup.deduplicated(data.documents(spark), threshold=1).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 7, 8, None, 9, 10, 11, 12, 13}
    assert line_dedup.deduplicated(data.documents(spark, []), threshold=1).count() == 0


@pytest.mark.parametrize("broadcast, bits", [(1 << 21, 48), (0, 3)])
def test_short_lines_and_rows_without_id(spark, monkeypatch, broadcast, bits):
    """Lines of 11 and 12 characters link; rows without id are a document for each text."""
    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", broadcast)
    monkeypatch.setattr(line_dedup, "MARK_BITS", bits)
    texts = ["elevenchars\nown a b c d e f", "elevenchbrs", "twelve chars", "twelve chbr", "ab\nax", "ab"]
    docs = data.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {(r.doc_id, r.place): r.kept for r in line_dedup.line_classes(docs).collect()}
    assert got == {(0, 0): True, (0, 1): True, (1, 0): False, (2, 0): True, (3, 0): False, (4, 0): True, (4, 1): True, (5, 0): False}
    raised = {(r.doc_id, r.place): r.kept for r in line_dedup.line_classes(docs, min_chars=12).collect()}
    assert raised[1, 0] and raised[3, 0] and not raised[5, 0]
    lone = [(None, f"first line {c * 9}\nsame line for all of them", "en", "a") for c in "abcd" * 3] + [(7, "same line for all of them", "en", "a")]
    rows = line_dedup.deduplicated(data.documents(spark, lone)).collect()
    assert len(rows) == 5
    assert all((r.n_lines, r.n_dropped, r.dropped) == ((1, 0, []) if r.doc_id == 7 else (2, 1, [1])) for r in rows)


def scores(rows, share, min_count=2):
    """By id (words, words scored by their bigram, score), by counting in dictionaries."""
    texts = [(i, data.words(t)) for i, t in rows]
    counts = Counter(w for _, ws in texts for w in ws)
    total = sum(counts.values())
    least = max(1, math.ceil(share * total))
    texts = [(i, [w if counts[w] >= least else None for w in ws]) for i, ws in texts]
    counts = Counter(w for _, ws in texts for w in ws)
    pairs = Counter(p for _, ws in texts for p in zip(ws, ws[1:]))
    out = {}
    for i, ws in texts:
        n, seen, score = out.get(i, (0, 0, 0.0))
        for k, w in enumerate(ws):
            before = ws[k - 1] if k else None
            if k and pairs[before, w] >= min_count:
                score += math.log(pairs[before, w] / counts[before])
                seen += 1
            else:
                score += math.log(counts[w] / total * (lm_scoring.BACKOFF if k else 1))
        out[i] = (n + len(ws), seen, score)
    return out


@pytest.mark.parametrize("share, n_top", [(1e-6, 256), (0.02, 4)])
def test_backoff_scores_match_counting(spark, share, n_top):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(i, t) for i, t, *_ in data.ROWS if not t or len(t) < 500]
    docs = data.documents(spark, [(*r, "en", "a") for r in rows])
    got = {r.doc_id: r for r in lm_scoring.backoff_scores(docs, share=share, n_top=n_top).collect()}
    want = scores(rows, share)
    assert got.keys() == want.keys()
    for i, (n, seen, score) in want.items():
        assert (got[i].n_words, got[i].n_seen) == (n, seen)
        assert got[i].score == pytest.approx(score, abs=1e-6)
        assert (got[i].mean is None) == (n == 0)


def test_scores_of_an_empty_table(spark):
    assert lm_scoring.backoff_scores(data.documents(spark, [])).count() == 0


@pytest.mark.parametrize("min_count, known, n_top", [(2, 0.01, 4), (1, 0.03, 8), (2, 1.0, 256), (2, 1e-6, 256)])
def test_every_word_counts_for_itself(spark, min_count, known, n_top):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(200 + i, "once upon once upon rare%d rare%d pair" % (i // 2, i // 2 + 1)) for i in range(6)]
    rows += [(i, t) for i, t, *_ in data.ROWS if not t or len(t) < 500]
    docs = data.documents(spark, [(*r, "en", "a") for r in rows])
    got = {r.doc_id: r for r in lm_scoring.backoff_scores(docs, min_count, n_top=n_top, known=known).collect()}
    want = scores(rows, 0, min_count)
    assert got.keys() == want.keys()
    for i, (n, seen, score) in want.items():
        assert (got[i].n_words, got[i].n_seen) == (n, seen)
        assert got[i].score == pytest.approx(score, abs=1e-6)


def test_a_corpus_beyond_a_million_words_keeps_rare_words(spark):
    rows = [(i, "common " * 120_000 + f"rare{i}") for i in range(10)]
    docs = data.documents(spark, [(*r, "en", "a") for r in rows])
    want = scores(rows, 0)
    for r in lm_scoring.backoff_scores(docs).collect():
        assert (r.n_words, r.n_seen) == want[r.doc_id][:2]
        assert r.score == pytest.approx(want[r.doc_id][2], abs=1e-6)


def test_registered_lines_within_two_edits(spark, tmp_path):
    line = "this long line of text has one short word ha in the middle of it"
    rows = [(1, line), (2, line.replace(" ha ", " or ")), (3, line.replace(" ha ", " rere ort "))]
    data.documents(spark, [(*r, "en", "a") for r in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_dropped for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("threshold, chars", [(1, 4), (2, 8), (2, 32)])
def test_pairs_dropped_early_are_no_partners(spark, threshold, chars):
    rng = random.Random(threshold + chars)
    pairs = [("", ""), ("", "a"), ("abc", "abcabc"), ("x" * 40, "y" * 40)]
    for _ in range(150):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 70)))
        b = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 70)))
        pairs.append((a, rng.choice([edited(rng, a, rng.randint(0, 5)), b])))
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold, chars).alias("w")).collect()
    assert all(r.w for r in got if distance(r.a, r.b) <= threshold)
    assert sum(not r.w for r in got) > 20


@pytest.mark.parametrize("threshold", [1, 2])
def test_sketches_of_near_lines_differ_by_little(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(100):
        a = "".join(rng.choice("abcé xyz日本語9") for _ in range(rng.randint(1, 70)))
        pairs.append((a, edited(rng, a, rng.randint(0, threshold)), True))
        pairs.append((a, a + "jklm" if threshold == 1 else a + "jklmo", False))
    rows = spark.createDataFrame(pairs, "a string, b string, near boolean")
    rows = rows.select("near", line_dedup._sketch(F.col("a")).alias("sa"), line_dedup._sketch(F.col("b")).alias("sb"))
    got = rows.select("near", line_dedup._apart("sa", "sb").alias("d")).collect()
    assert all((r.d <= 2 * threshold) == r.near for r in got)


def test_a_family_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Each copy has four letters put in somewhere, so two of them share a segment but are eight edits apart."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    lines = set()
    while len(lines) < 120:
        at = rng.randrange(len(base))
        lines.add(base[:at] + "".join(rng.sample("abcdefghijklmnopqrs", 4)) + base[at:])
    docs = data.documents(spark, [(i, x, "en", "a") for i, x in enumerate(sorted(lines))])
    counted, real = [], line_dedup._verified

    def verified(pairs, *rest):
        counted.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", verified)
    got = line_dedup.line_classes(docs).collect()
    assert len(got) == 120 and sum(counted) < 120 * 119 / 2 / 3


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_rows_among_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", broadcast)
    monkeypatch.setattr(line_dedup, "TABLE_BITS", 9)
    rows = spark.range(-500, 500).withColumn("line", F.col("id").cast("string"))
    keys = spark.range(-500, 500, 7).union(spark.createDataFrame([(1 << 62,), (9999,)], "id long"))
    got = line_dedup._among(rows, "id", keys).collect()
    assert sorted((r.id, r.line) for r in got) == [(i, str(i)) for i in range(-500, 500, 7)]
    assert line_dedup._among(rows, "id", keys.limit(0)).count() == 0


def test_texts_of_all_lines_are_shuffled_once(spark, monkeypatch):
    """With every join a shuffle unless told, the texts of linked lines are still picked out without one."""
    plans, real = [], line_dedup.cut_lineage

    def cut(df):
        if "sketch" in df.columns and "line" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(line_dedup, "cut_lineage", cut)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert line_dedup.line_classes(data.documents(spark)).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0]
