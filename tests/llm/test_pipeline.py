"""The pipeline against a plain version of each stage, and its registered queries."""

import re

import corpus_pipeline
from manualdex.llm import quality, queries
from tests.llm import data
from tests.llm.test_selection import windows


def test_stages_match_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        steps[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good, exact, near, clean = steps.values()

    rules = queries.quality_rules(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    )
    scored = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), rules)
    assert good == {r.doc_id for r in scored.filter("score >= 0.3").collect()} and len(good) < len(rows)

    best = {}
    for i in good:
        key = rows[i].translate(data.UPPER)
        best[key] = max(best.get(key, i), i)
    assert exact == set(best.values()) and len(exact) < len(good)

    found = data.near([(i, rows[i]) for i in sorted(exact)], 5, 80)
    assert near == {i for i, (_, c) in found.items() if i == c} and len(near) < len(exact)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = [(i, rows[i]) for i in near if _touches(rows[i], items)]
    assert clean == near - {i for i, _ in windows(seen, items)} and len(clean) < len(near)

    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    taken = mixed.groupBy("doc_id").agg({"words": "sum"}).collect()
    assert {r.doc_id for r in taken} <= clean
    total = sum(len(data.words(rows[i])) for i in clean)
    words = sum(r[1] for r in taken)
    assert 1.5 * total - 20 - 1 <= words <= 1.5 * total


def _touches(text, items):
    """Whether a text shares five words in a row with an item."""
    def runs(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(data.UPPER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = runs(text)
    return any(own & runs(t) for _, t in items)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    extra = data.documents(spark)
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, data.BASE)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    kept = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} <= {None, 7, 8, 9, 11, 12, 13}
    for name in ("documents", "labels", "benchmark"):
        part = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        part.limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_entry_registers_one_query_per_operator():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_without_id_or_with_a_repeated_id(spark):
    other = " ".join(f"o{i}" for i in range(40))
    third = " ".join(f"t{i}" for i in range(40))
    rows = [
        (1, data.BASE),
        (None, data.BASE + " indeed"),
        (None, other),
        (None, other + " end"),
        (None, third),
        (None, "alone"),
        (5, "five words of one text"),
        (5, "five words of another one"),
        (5, data.BASE + " yes"),
    ]
    docs = data.documents(spark, [(i, t, "en", "a") for i, t in rows])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    (copy,) = [t for i, t in kept if i is None and t.startswith(other)]
    assert sorted(kept, key=str) == sorted([rows[0], (None, copy), rows[4], rows[5], rows[6], rows[7]], key=str)
