"""Every registered query: ``name -> callable(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from manualdex.functions import text as X
from manualdex.operators import matching as M
from manualdex.plans import explain, registered_batch, registered_catalog, registered_jobs, registered_scalars
from manualdex.plans import search as S
from manualdex.sources import derived as D


def _search(query: str, **kw):
    return lambda spark, sf: S.search(D.texts(spark, sf), query, **kw)


def _by_postings(query: str):
    return lambda spark, sf: S.search_by_postings(D.texts(spark, sf), D.postings(spark, sf), query)


def _snippets(spark, sf):
    files = D.texts(spark, sf)
    reqs = M.read_query(spark, "terex онк160с")
    return S.with_snippet(S.matching_files(files, reqs), reqs).select("id", "snippet")


def _search_summary(spark, sf):
    return S.search_summary(S.search(D.texts(spark, sf), "гидроаккумулятор"))


def _field_hits(spark, sf):
    req = M.read_query(spark, "онк-160с")[0]
    return D.texts(spark, sf).select(
        "id",
        M.hit("filename", req).alias("name_hit"),
        M.hit("filepath", req).alias("path_hit"),
        M.hit("content", req).alias("content_hit"),
    )


def _match_ids(query: str):
    def run(spark, sf):
        reqs = M.read_query(spark, query)
        return D.texts(spark, sf).filter(M.matches_all(reqs)).select("id")

    return run


def _final_ids(query: str):
    def run(spark, sf):
        return S.matching_files(D.texts(spark, sf), M.read_query(spark, query)).select("id")

    return run


def _model_evidence(spark, sf):
    req = M.read_query(spark, "ac 35 l")[0]
    pieces = M.mentions(M.text_of("content"), F.lit(req.pattern))
    return (
        D.texts(spark, sf)
        .filter(M.hit("content", req))
        .select(
            "id",
            M.first_position(pieces).alias("first_position"),
            M.mention_count(pieces).alias("mentions"),
        )
    )


def _relevance(spark, sf):
    reqs = M.read_query(spark, "terex ac35l")
    return D.texts(spark, sf).select("id", M.relevance(reqs).alias("score"))


def _numeric(spark, sf):
    return D.texts(spark, sf).filter(M.numeric_in_metadata("кс55724")).select("id")


def _prefilter(spark, sf):
    reqs = M.read_query(spark, "pat онк160с")
    return D.texts(spark, sf).filter(S.coarse_filter(reqs)).select("id")


def _substring_probe(spark, sf):
    return explain.substring_probe(D.texts(spark, sf), "55724")


def _substring_total(spark, sf):
    return explain.substring_total(D.texts(spark, sf), "55724")


def _by_index(probe, token):
    return lambda spark, sf: probe(D.texts(spark, sf), D.substring_index(spark, sf), token)


def _match_explain(spark, sf):
    return explain.match_explain(
        D.texts(spark, sf), "ОНК 160С E10", "160", first_path="%онк%160%"
    ).select(
        "position", "id", "requirement_no", "kind", "value", "name_hit", "path_hit", "content_hit",
        F.size("contexts").alias("context_count"),
        F.coalesce(F.get("contexts", F.lit(0)), F.lit("")).alias("first_context"),
    )


def _variant_hits(spark, sf):
    return explain.variant_hits(
        D.texts(spark, sf), "онк160с", {"latin_hits": "e10", "cyrillic_hits": "е10"}
    )


def _variant_hits_multi(spark, sf):
    return explain.variant_hits(
        D.texts(spark, sf), "онк160с", {"one": "e10", "two": "e10 terex", "none": "e10 nosuchword"}
    )


def _variant_examples(spark, sf):
    return explain.variant_examples(D.texts(spark, sf), "онк160с", "e10")


def _questions(column):
    return lambda spark, sf: D.questions(spark, sf).select("question_id", column())


def _joined(tokens):
    return F.array_join(tokens, " ")


def _tech_tokens(spark, sf):
    return (
        D.questions(spark, sf)
        .select("question_id", F.posexplode(X.raw_tokens(F.col("question"))).alias("pos", "token"))
        .filter(X.is_tech(F.col("token")))
        .select("question_id", "pos", "token", X.is_fault(F.col("token")).alias("is_fault"))
    )


def _requirements(spark, sf):
    return (
        D.questions(spark, sf)
        .select("question_id", F.posexplode(X.requirements(F.col("question"))).alias("pos", "r"))
        .select("question_id", "pos", "r.kind", "r.value")
    )


def _tech_groups(spark, sf):
    return (
        _requirements(spark, sf)
        .filter(F.col("kind") == "tech")
        .select(
            "question_id", "pos", "value",
            F.array_join(X.code_groups(F.col("value")), "|").alias("groups"),
        )
    )


SEARCH = {
    "search_word": _search("гидроаккумулятор"),
    "search_single_model": _search("ds350"),
    "search_split_code": _search("кс 55724"),
    "search_lookalike": _search("онк-160с"),
    "search_brand_model": _search("pat ac35l"),
    "search_fault": _search("e10"),
    "search_multi": _search("dana spicer"),
    "diagnostic_search": _search("онк160с e10"),
    "diagnostic_search_three": _search("pat ds350 e15"),
    "search_by_postings": _by_postings("ds350"),
    "search_by_postings_multi": _by_postings("pat ds350 e15"),
    "search_request_limit": _search("ac 35 l", limit=S.REQUEST_LIMIT),
    "search_snippets": _snippets,
    "search_summary": _search_summary,
    "single_model_search": _final_ids("ac 35 l"),
    "brand_model_search": _final_ids("terex онк160с"),
    "match_all": _match_ids("pat ds350 e15"),
    "word_match": _match_ids("pat"),
    "tech_match": _match_ids("ac 35 l"),
    "field_hits": _field_hits,
    "model_evidence": _model_evidence,
    "relevance_score": _relevance,
    "numeric_model_metadata": _numeric,
    "candidate_prefilter": _prefilter,
    "substring_probe": _substring_probe,
    "substring_total": _substring_total,
    "substring_by_index": _by_index(explain.substring_probe_by_index, "55724"),
    "substring_total_by_index": _by_index(explain.substring_total_by_index, "Гидроаккум"),
    "substring_words_by_index": _by_index(explain.substring_total_by_index, "er the th"),
    "match_explain": _match_explain,
    "variant_hits": _variant_hits,
    "variant_hits_multi": _variant_hits_multi,
    "variant_examples": _variant_examples,
}

TEXT = {
    "raw_tokens": _questions(lambda: _joined(X.raw_tokens(F.col("question"))).alias("tokens")),
    "compact_code": _questions(lambda: X.compact(F.col("question")).alias("compact")),
    "merge_codes": _questions(lambda: _joined(X.merged_tokens(F.col("question"))).alias("tokens")),
    "lookalike_fold": _questions(lambda: X.fold_lookalikes(F.col("question")).alias("folded")),
    "tech_tokens": _tech_tokens,
    "query_requirements": _requirements,
    "tech_groups": _tech_groups,
}

PARTS = [SEARCH, TEXT, *registered_catalog.PARTS, *registered_batch.PARTS, *registered_scalars.PARTS, *registered_jobs.PARTS]
