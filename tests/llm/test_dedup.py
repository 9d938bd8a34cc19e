import hashlib
import random

import pyarrow as pa
import pytest

from manualdex.llm import exact_dedup, minhash
from manualdex.llm.components import components
from tests.llm import data


def test_exact_dedup_keeps_one_of_equal_texts(spark):
    got = exact_dedup.exact_dedup(data.documents(spark)).collect()
    assert len(got) == len(data.ROWS)
    norm = {}
    for i, t, *_ in data.ROWS:
        norm.setdefault((t or "").translate(data.UPPER), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in norm.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(norm) and len({r.text_sha256 for r in kept}) == len(norm)


def test_exact_dedup_smallest_and_empty(spark):
    got = exact_dedup.exact_dedup(data.documents(spark), keep="smallest").filter("kept").collect()
    assert {r.doc_id for r in got} == {1, 3, 4, 6, 7, 8, None, 9, 10, 11, 12, 13}
    assert exact_dedup.exact_dedup(data.documents(spark, [])).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "same TEXT" if i % 3 else f"own {i}", "en", "a") for i in range(3000)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(data.documents(spark, rows)).collect()}
    assert got[1].group_size == 2000 and got[1].keep_id == 2999 and sum(r.kept for r in got.values()) == 1001


@pytest.mark.parametrize("n, percent", [(5, 80), (3, 85)])
def test_near_duplicates_match_all_pairs(spark, n, percent):
    rng = random.Random(n)
    rows, vocabulary = [], [f"v{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 90))] + (shared if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "a"))
    got = minhash.near_duplicates(data.documents(spark, rows), n, percent).collect()
    want = data.near([(i, t) for i, t, *_ in rows], n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_awkward_rows(spark):
    got = minhash.near_duplicates(data.documents(spark)).collect()
    assert len(got) == len(data.ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13)] == [1, 1, 1, 4, 5, 6, 7, 8, 9, 9, 13]
    assert by[4].n_shingles == by[6].n_shingles == 0 and by[13].n_shingles == 1
    without = {(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None}
    assert without == {(by[1].n_shingles, 1, False), (1, None, True)}
    assert minhash.near_duplicates(data.documents(spark, [])).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, None), (7, 7)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_match_threshold_keeps_nearly_all_pairs():
    t = minhash.match_threshold(32, 0.8)
    assert 8 <= t <= 16 and minhash.match_threshold(32, 0.85) >= t


def test_dense_family_around_the_threshold(spark):
    """Copies of one text, each with a random part of the same edits: many pairs lie near the threshold."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    sites = rng.sample(range(150), 40)
    rows = []
    for i in range(260):
        copy = list(base)
        for at in rng.sample(sites, rng.choice([1, 3, 6, 9, 12])):
            copy[at] = f"e{at}"
        rows.append((i, " ".join(copy), "en", "a"))
    got = minhash.near_duplicates(data.documents(spark, rows), 3, 85).collect()
    want = data.near([(i, t) for i, t, *_ in rows], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 260


def test_copies_without_id_are_spread(spark, monkeypatch):
    """Copies of one text, none with an id: one group, one row kept, over several salts."""
    written = []
    cut = exact_dedup.cut_lineage
    monkeypatch.setattr(exact_dedup, "cut_lineage", lambda rows: written.append(cut(rows)) or written[-1])
    docs = spark.createDataFrame([(None, "Same text")] * 300 + [(None, "other"), (4, "OTHER")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs.repartition(4)).collect()
    same = [r for r in got if r.group_size == 300]
    assert len(same) == 300 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {None}
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in got if r.group_size == 2) == [(False, 4, True), (True, 4, False)]
    assert written[0].select("salt").distinct().count() > 20


def test_lots_are_compared_with_blocks_like_single_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 200)
    rng = random.Random(11)
    base = rng.sample(range(10**6), 60)
    sets = {i: sorted({*rng.sample(base, rng.randint(44, 60)), *rng.sample(range(10**6), rng.randint(0, 9))}) for i in range(60)}
    comp = {i: i % 7 if i < 30 else i for i in sets}
    posts = spark.createDataFrame([(i, len(s), comp[i]) for i, s in sets.items()], "rep long, n long, comp long")
    shingles = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "rep long, shingle long")
    leaders = spark.createDataFrame([(i, 0) for i in sets if i], "a long, b long")
    got = {tuple(r) for r in minhash._across(posts, shingles, leaders, 85).collect()}
    near = {(a, b) for a, x in sets.items() for b, y in sets.items() if comp[a] != comp[b] and 100 * len({*x} & {*y}) >= 85 * len({*x, *y})}
    assert got and got <= near
    joined = lambda links: {frozenset(c) for c in groups(sets, [*links, *((i, comp[i]) for i in sets)])}
    assert joined(got) == joined(near)
    # A lot and a block each hold few sets, whatever the size of the family, and a class meets each block once.
    met = minhash._linked_sets(85)
    row = [{"rep": i, "n": len(s), "comp": comp[i], "whole": s} for i, s in sets.items()]
    batch = pa.RecordBatch.from_pylist([{"asked": row, "held": row}])
    least = {}
    for a, b in near:
        least[a, comp[b]] = min(b, least.get((a, comp[b]), b))
    assert {tuple(r.values()) for out in met([batch]) for r in out.to_pylist()} == {(a, c, b) for (a, c), b in least.items()}


def groups(ids, links):
    head = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    out = {}
    for i, h in head.items():
        out.setdefault(h, set()).add(i)
    return out.values()
