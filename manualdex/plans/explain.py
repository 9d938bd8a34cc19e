"""Why a document matched: hits per field, contexts, substring and spelling probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.functions import excerpt as E
from manualdex.functions import text as X
from manualdex.operators import matching as M
from manualdex.operators import substrings
from manualdex.operators.topk import top_k
from manualdex.schema import TEXT_BEARING_EXTENSIONS
from manualdex.sources.catalog import lookup, with_text_facts

CONTEXT_RADIUS = 140
VARIANT_RADIUS = 120


def substring_probe(files: DataFrame, token: str, limit: int = 100) -> DataFrame:
    """Documents holding the token as plain text, in id order, with hits per field."""
    needle = token.lower()

    def at(field: str) -> Column:
        return F.lower(M.text_of(field)).contains(needle)

    content = M.text_of("content")
    start = F.locate(needle, F.lower(content)) - 1
    spot = F.struct(start.alias("start"), F.lit(len(token)).alias("length"))
    hits = files.filter(at("filename") | at("filepath") | at("content")).select(
        "id",
        "filename",
        "extension",
        "filepath",
        at("filename").alias("name_hit"),
        at("filepath").alias("path_hit"),
        at("content").alias("content_hit"),
        F.when(at("content"), E.around(content, spot, CONTEXT_RADIUS, dots=False))
        .otherwise("")
        .alias("context"),
    )
    return top_k(hits, [F.col("id")], limit).drop("rank")


def substring_total(files: DataFrame, token: str) -> DataFrame:
    needle = token.lower()
    test = M._any([F.lower(M.text_of(f)).contains(needle) for f in M.FIELDS])
    return files.filter(test).agg(F.count(F.lit(1)).alias("total"))


def substring_probe_by_index(files: DataFrame, index: substrings.Index, token: str, limit: int = 100) -> DataFrame:
    """``substring_probe`` that tests the texts of trigram candidates only."""
    return substring_probe(substrings.candidate_rows(files, index, token.lower()), token, limit)


def substring_total_by_index(files: DataFrame, index: substrings.Index, token: str) -> DataFrame:
    """``substring_total`` that tests the texts of trigram candidates only."""
    return substring_total(substrings.candidate_rows(files, index, token.lower()), token)


def contexts(text: Column, pattern: Column, radius: int, limit: int = 3) -> Column:
    """Up to ``limit`` excerpts, one per match, from the text cut at its matches."""
    pieces = F.split(text, pattern, limit + 1)
    found = F.slice(F.regexp_extract_all(text, pattern, F.lit(0)), 1, limit)

    def excerpt(length: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda s, p: s + F.char_length(p))
        matched = F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, m: s + F.char_length(m))
        spot = F.struct((before + matched).alias("start"), F.char_length(length).alias("length"))
        return E.around(text, spot, radius, dots=False)

    return F.transform(found, excerpt)


def match_explain(
    files: DataFrame,
    query: str,
    part: str,
    first_path: str = "",
    limit: int = 40,
) -> DataFrame:
    """Per document and requirement: hits in each field and contexts in the text.

    Of the documents that bear text and hold ``part`` in name or path, the first ``limit``
    are explained, those whose path matches ``first_path`` before the others. They are
    picked from catalog columns alone; texts are then read for the picked ids only.
    """
    spark = files.sparkSession
    reqs = M.read_query(spark, query)
    named = F.lower(M.text_of("filename")).contains(part.lower()) | F.lower(
        M.text_of("filepath")
    ).contains(part.lower())
    first = F.lower("filepath").like(first_path) if first_path else F.lit(True)
    bearing = (
        with_text_facts(files)
        .filter(named)
        .filter(F.lower(M.text_of("extension")).isin(*TEXT_BEARING_EXTENSIONS))
        .filter(F.col("trimmed_chars") > 0)
        .select("id", "filename", F.when(first, 0).otherwise(1).alias("_group"))
    )
    # The picked ids are at most ``limit`` numbers.
    order = [F.col("_group"), F.col("filename"), F.col("id")]
    picked = top_k(bearing, order, limit, rank="position").orderBy("position").select("id").collect()
    ids = [row["id"] for row in picked]
    place = F.array_position(F.lit(ids), F.col("id")).cast("int")
    content = M.text_of("content")
    kind = "array<struct<requirement_no:int,kind:string,value:string,name_hit:boolean,"
    kind += "path_hit:boolean,content_hit:boolean,contexts:array<string>>>"
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("requirement_no"),
                F.lit(r.kind).alias("kind"),
                F.lit(r.value).alias("value"),
                M.hit("filename", r).alias("name_hit"),
                M.hit("filepath", r).alias("path_hit"),
                M.hit("content", r).alias("content_hit"),
                contexts(content, F.lit(r.pattern), CONTEXT_RADIUS).alias("contexts"),
            )
            for i, r in enumerate(reqs)
        ]
    ).cast(kind)
    return (
        lookup(files, *ids)
        .select(place.alias("position"), "id", "filename", rows.alias("_rows"))
        .select("position", "id", "filename", F.explode("_rows").alias("r"))
        .select("position", "id", "filename", "r.*")
    )


def variant_hits(files: DataFrame, context_code: str, spellings: dict[str, str]) -> DataFrame:
    """How many text documents about one code hold each spelling of another code.

    Of an input of several tokens all count: in name or path for ``context_code``, in the
    text for a spelling. An input without tokens matches nothing.
    """
    spark = files.sparkSession
    context = M.read_query(spark, context_code)
    source = files.filter(
        F.lower(M.text_of("extension")).isin(*TEXT_BEARING_EXTENSIONS)
        & (F.char_length(M.text_of("content")) > 0)
        & M.all_in_metadata(context)
    )
    sums = [
        F.count_if(M.all_in("content", M.read_query(spark, code))).alias(label)
        for label, code in spellings.items()
    ]
    return source.agg(F.count(F.lit(1)).alias("context_documents"), *sums)


def variant_examples(
    files: DataFrame, context_code: str, spelling: str, limit: int = 20
) -> DataFrame:
    """Documents about a code that hold a spelling, with an excerpt at its first token."""
    spark = files.sparkSession
    reqs = M.read_query(spark, spelling)
    content = M.text_of("content")
    spot = E.anchor(content, F.lit(reqs[0].pattern if reqs else r"\z"))
    hits = files.filter(
        F.lower(M.text_of("extension")).isin(*TEXT_BEARING_EXTENSIONS)
        & M.all_in_metadata(M.read_query(spark, context_code))
        & M.all_in("content", reqs)
    ).select("id", "filename", "filepath", E.around(content, spot, VARIANT_RADIUS, False).alias("excerpt"))
    return top_k(hits, [F.col("id")], limit).drop("rank")
