import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manualdex.llm import decontaminate, html_text, mixing, tables
from tests.llm import data


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing what is left over again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        money = left - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else weight[s] * money / rest for s in names}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_share_the_excess(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 900, 20_000]) for i in range(9)} | {None: 70, "Z": 5, "é": 40}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(targets(sizes))


def test_mix_reaches_each_target(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    docs = data.documents(spark, rows + data.ROWS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) + len(data.ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part
    assert target == pytest.approx(targets(sizes))
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(data.documents(spark, [])).count() == 0


def test_mixture_repeats_and_cuts(spark):
    docs = data.documents(spark, [(i, f"a b c {i}", "en", "ab"[i % 10 == 0]) for i in range(100)])
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    passes, words = Counter(), Counter()
    for r in mixing.mixture(docs).collect():
        passes[r.doc_id] += 1
        words[r.doc_id] += r.words
    assert {i: p.taken for i, p in plan.items() if p.taken} == dict(words)
    assert all(passes[i] == p.epochs + (p.part > 0) for i, p in plan.items())


def test_mixture_of_repeated_rows_keeps_to_the_budget(spark):
    """A third of the rows without id, equal in text, at the cut; columns named as those used inside."""
    rows = [(None if i % 3 else i, "five words in a row" if i % 3 else f"one {i}", "a" if i % 3 else "b", i, "k", i % 2, 3, 4, "r") for i in range(300)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, source string, _id long, _key string, _place int, n int, first int, `rows` string"
    )
    plan = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    mixed = mixing.mixture(docs).collect()
    for source in "ab":
        assert sum(r.words for r in mixed if r.source == source) == sum(p.taken for p in plan if p.source == source)
    by_row = Counter()
    for r in mixed:
        assert (r._id, r._key, r.first) == (r._id, "k", 4)
        by_row[r._id] += r.words
    sizes = {r[3]: len(r[1].split()) for r in rows}
    assert set(by_row) <= set(sizes) and all(v <= 2 * sizes[i] for i, v in by_row.items())
    again = sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    assert again == sorted(map(str, mixed))


def test_kept_rows_of_clashing_names(spark):
    rows = [(1, "x", 77, "a"), (1, "x", 88, "b"), (None, "y", 99, "c"), (2, "z", 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _KEY string")
    keys = spark.createDataFrame([(1, "x"), (None, "y")], "id long, text_key string")
    got = tables.kept_rows(docs, keys, F.col("text"))
    assert got.schema == docs.schema
    first = [tuple(r) for r in sorted(got.collect(), key=str)]
    assert set(first) < set(rows) and len(first) == 2 and {r[0] for r in first} == {1, None}
    assert first == [tuple(r) for r in sorted(tables.kept_rows(docs.repartition(3), keys, F.col("text")).collect(), key=str)]


def windows(rows, items):
    """Best window of each item in each text, by comparing all windows."""
    def split(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(data.UPPER))

    def grams_of(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    out = {}
    for i, text in rows:
        w = split(text)
        for k, item in items:
            v = split(item)
            n = min(5, len(v))
            own = grams_of(v, n) if v else Counter()
            for s in range(max(len(w) - len(v), 0) + 1 if v else 0):
                here = grams_of(w[s : s + len(v)], n)
                if here and (sim := sum((own & here).values()) / sum((own | here).values())) >= 0.8:
                    if (i, k) not in out or sim > out[i, k][0] + 1e-12:
                        out[i, k] = (sim, s)
    return out


def test_windows_match_a_full_comparison(spark):
    rng = random.Random(2)
    vocabulary = [f"q{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 5, 9, 20, 20, 33, 50, 0])]
    items += [(50, None), (51, items[4][1].upper() + "!")]
    rows = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 2:
            passage = (items[rng.randrange(7)][1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage[: rng.choice([len(passage), len(passage) - 1])]
        rows.append((i, ", ".join(body).title(), "en", "a"))
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "q1", "en", "a")]
    docs = data.documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(docs, bench).collect()}
    want = windows([(i, t) for i, t, *_ in rows], items)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    clean = decontaminate.clean_rows(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in want}
    assert clean.columns == docs.columns
    assert decontaminate.clean_rows(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(data.documents(spark, []), bench).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(7)]
    docs = data.documents(spark, [(k, "before " + t + " after", "en", "a") for k, t in items] + data.ROWS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(7)]
    assert decontaminate.clean_rows(docs, bench).count() == len(data.ROWS)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h2>Title &amp; more</h2><p>One&nbsp;two <i>th</i>ree
 &lt;four&gt;<br>five<div class="ad-box">Buy this</div><p>Next one here<script>var x = "<p>no</p>";</script>
<ul><li>first item here<li>second item here</ul><section id="comments"><p>Reader says</section>{close}
<aside>Side</aside><form><label>Name</label></form><footer>&copy; Foot</footer>"""
TEXT = "Title & more\nOne two three <four> five\nNext one here\nfirst item here\nsecond item here"


@pytest.mark.parametrize("mark", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='x'>", "</div>")])
def test_main_text_with_and_without_a_mark(mark):
    weights = html_text.Weights({k: tuple(v) for k, v in html_text.evidence(
        html_text.read("<body><nav>m</nav><article><p>a b c</p></article><footer>f</footer></body>")).items()})
    assert html_text.main_text(PAGE.format(open=mark[0], close=mark[1]), weights) == TEXT


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages, html_text.learn(pages)).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        import html

        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got[p.page_id].text == "\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (4, "u", "<p>open"), (4, "u", "<p>open"),
            (5, "u", "<div><div>" * 3000 + "deep"), (6, "u", "a < b <!-- c"), (7, "u", "<nav>only menu"), (8, "u", "<" * 5000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, kind string")
    got = [(r.page_id, r.text) for r in html_text.extract(pages, html_text.learn(pages)).collect()]
    want = [(1, ""), (2, ""), (None, "plain text"), (4, "open"), (4, "open"), (5, "deep"), (6, "a < b"), (7, ""), (8, "<" * 5000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0))).count() == 0


def test_best_run_is_the_best_of_all_runs():
    rng = random.Random(3)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, 0, 0, 1, 2, 3]) for _ in range(rng.randint(0, 25))]
        runs = [(-sum(scores[i:j]), j - i, i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        best = min(runs, default=(0, 0, 0))
        want = (best[2], best[2] + best[1]) if best[0] < 0 else (0, 0)
        assert html_text.best_run(np.array(scores, np.int64)) == want


BODY = " ".join(f"body{i}" for i in range(40))
LABELLED = "<html><body><article><h1>one two</h1><p>a b c d e</p><div>taken in here</div></article><div>left out here</div></body></html>"


@pytest.mark.parametrize("page, text", [
    (f"<main><div class='post'>{BODY}</div><section class='comments'><article>one comment</article></section></main>", BODY),
    (f"<body><div><p>{BODY}</p></div><aside><article>teaser item</article></aside></body>", BODY),
    (f"<main><p>{BODY}</p><article>related item</article></main>", BODY),
    (f"<body><h1>Title</h1><p>{BODY}</p><p>End, <a href=x>here</a></p><div class='foot'>Copyright 2024</div>", f"Title\n{BODY}\nEnd, here"),
    (f"<article><p>first</p><div class='related-work'>{BODY}</div><div class='notice-of-claim'>{BODY}</div></article>", f"first\n{BODY}\n{BODY}"),
    (f"<article><p>{BODY}</p><div class='comments-area'>{BODY}</div><div class='social share-box'>x</div></article>", BODY),
    (f"<body><article>{BODY}</article><article>{BODY}</article></body>", f"{BODY}\n{BODY}"),
    ("<div>stray line</div><article><p>few words</p></article>", "few words"),
])
def test_the_run_decides(page, text):
    """Marks label pages for the counts and don't filter the text of a page."""
    total = {}
    for _ in range(50):
        for kind, (i, o) in html_text.evidence(html_text.read(LABELLED)).items():
            was = total.get(kind, (0, 0))
            total[kind] = (was[0] + i, was[1] + o)
    assert total["word div"] == (150, 150) and total["word p"] == (250, 0)
    assert html_text.main_text(page, html_text.Weights(total)) == text


def test_labels_are_marks_that_hold_most_words():
    def labelled(page):
        page = html_text.read(page)
        span = html_text.label(page)
        return span and "".join(page.text[span[0] : span[1]])

    assert labelled("<body>x<article><p>a b c</article>") == "a b c"
    assert labelled("<main>a b<aside><article>c</article></aside> c d") == "a b c d"
    assert labelled("<p>a b c d<article>x</article>") is None
    assert labelled("<main><article>a</article><article>b c</article></main>") == "ab c"
    assert labelled("<p>a b c") is None and labelled("") is None
