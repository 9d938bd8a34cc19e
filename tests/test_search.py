"""Search results: known counts, batch against single search, both join forms."""

import pytest
from pyspark.sql import functions as F

from manualdex.operators import matching as M
from manualdex.plans import batch as B
from manualdex.plans import search as S
from manualdex.sources import derived as D

# query: (documents meeting all requirements, documents after the context and model rules)
COUNTS = {
    "ds350": (108, 96),
    "кс 55724": (54, 47),
    "ac 35 l": (161, 143),
    "онк-160с": (107, 95),
    "e10": (86, 86),
    "гидроаккумулятор": (205, 205),
    "dana spicer": (143, 143),
    "pat ac35l": (23, 22),
    "terex онк160с": (17, 16),
    "terex ac35l": (23, 23),
    "pat e15": (4, 4),
    "pat ds350 e15": (2, 2),
    "онк160с e10": (16, 5),
}


@pytest.mark.parametrize("query", COUNTS)
def test_counts(spark, sf, query):
    files = D.catalog(spark, sf)
    reqs = M.read_query(spark, query)
    both = (files.filter(M.matches_all(reqs)).count(), S.matching_files(files, reqs).count())
    assert both == COUNTS[query]


@pytest.mark.parametrize("query", ["pat онк160с", "ac 35 l", "dana spicer"])
def test_coarse_filter_keeps_all_matches(spark, sf, query):
    files = D.catalog(spark, sf)
    reqs = M.read_query(spark, query)
    lost = files.filter(M.matches_all(reqs) & ~S.coarse_filter(reqs))
    assert lost.count() == 0


def test_empty_query(spark, sf):
    assert S.search(D.catalog(spark, sf), "   ").count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_batch_equals_single_search(spark, sf, broadcast):
    files = D.catalog(spark, sf)
    texts = [*COUNTS, "-", "", "нет такого слова", "ds350"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, query string")
    got = {
        (r["question_id"], r["rank"]): (r["file_id"], r["score"], r["snippet"])
        for r in B.batch_search(files, questions, 20, D.frequent_keys(spark, sf), broadcast).collect()
    }
    want = {
        (i, r["rank"]): (r["file_id"], r["score"], r["snippet"])
        for i, text in enumerate(texts)
        for r in S.search(files, text, 20).collect()
    }
    assert got == want


def test_shuffled_search_moves_keys_and_no_texts(spark, sf):
    """With no broadcast at all: documents and queries meet by key, and the shuffled rows hold no text."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        files = D.catalog(spark, sf)
        questions = spark.createDataFrame(list(enumerate(COUNTS)), "question_id long, query string")
        queries = B.distinct_queries(B.with_query_key(questions))
        got = B.search_queries(files, queries, 20, D.frequent_keys(spark, sf), broadcast=False).collect()
        want = B.search_queries(files, queries, 20, D.frequent_keys(spark, sf), broadcast=True).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and want
    finally:
        spark.conf.set(limit, before)


def test_query_without_tokens_gives_nothing(spark, sf):
    from manualdex.plans import assist, explain

    files = D.catalog(spark, sf)
    assert assist.context_chunks(files, "???").count() == 0
    assert explain.match_explain(files, "???", "160").count() == 0
    assert explain.variant_examples(files, "онк160с", "???").count() == 0
    assert files.filter(M.matches_all([])).count() == 0
    assert S.search_by_postings(files, D.postings(spark, sf), "???").count() == 0


@pytest.mark.parametrize("query", ["ds350", "pat e15", "dana spicer", "онк160с e10"])
def test_postings_give_the_same_results(spark, sf, query):
    files = D.catalog(spark, sf)
    got = S.search_by_postings(files, D.postings(spark, sf), query).collect()
    assert got == S.search(files, query).collect()


def test_hot_question(spark, sf):
    """One query asked by most questions, joined over salted partitions."""
    questions = spark.range(3000).select(
        F.col("id").alias("question_id"),
        F.when(F.col("id") % 3 > 0, "pat e15").otherwise(F.concat(F.lit("ds350 "), F.col("id") % 5)).alias("query"),
    )
    out = B.batch_search(D.catalog(spark, sf), questions, 5)
    counts = out.groupBy("question_id").count().filter(F.col("question_id") % 3 > 0)
    assert counts.agg(F.count("*"), F.min("count"), F.max("count")).first() == (2000, 4, 4)


def test_broadcast_is_size_checked(spark):
    queries = B.distinct_queries(
        B.with_query_key(spark.createDataFrame([(1, "ds350")], "question_id long, query string"))
    )
    assert B.fits_broadcast(queries)
    assert not B.fits_broadcast(queries, limit=10)


def test_search_plan_reads_only_needed_columns(spark, sf):
    plan = S.search(D.catalog(spark, sf), "ds350")._jdf.queryExecution().toString()
    assert "extraction_status" not in plan.split("ReadSchema")[-1]
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
