"""Search one query over a catalog: filter, score, excerpt, top-k in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.functions import excerpt as E
from manualdex.functions import text as X
from manualdex.operators import matching as M
from manualdex.operators import postings as P
from manualdex.operators.topk import top_k
from manualdex.session import cut_lineage

# Limits and the text shown when only name or path matched.
SEARCH_LIMIT = 200
REQUEST_LIMIT = 50
SNIPPET_RADIUS = 180
NAME_OR_PATH_TEXT = "Найдено в имени или пути файла"

RESULT_COLUMNS = (
    "rank", "file_id", "filename", "extension", "filepath", "snippet", "is_cloud", "score",
)


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.lower("filename").asc(), F.col("file_id").asc()]


def matching_files(files: DataFrame, reqs: list[M.Requirement]) -> DataFrame:
    if not reqs:
        return files.filter(F.lit(False))
    return files.filter(M.matches_query(reqs))


def with_snippet(df: DataFrame, reqs: list[M.Requirement], radius: int = SNIPPET_RADIUS) -> DataFrame:
    """Excerpt at the first requirement (in snippet order) found in the text."""
    content = M.text_of("content")
    found = F.coalesce(
        *[
            F.when(M.probe("content", r), E.anchor(content, F.lit(r.pattern)))
            for r in M.snippet_order(reqs)
        ]
    ) if reqs else F.lit(None).cast("struct<start:int,length:int>")
    return (
        df.withColumn("_hit", found)
        .withColumn(
            "snippet",
            F.coalesce(E.around(content, F.col("_hit"), radius, dots=True), F.lit("")),
        )
        .drop("_hit")
    )


def search(
    files: DataFrame,
    query: str,
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """Ranked results of one query.

    The excerpt is made before the cut to ``limit`` so that only short rows, never whole
    texts, leave the scan; it is only computed for rows that match.
    """
    reqs = M.read_query(files.sparkSession, query)
    hits = matching_files(files, reqs)
    hits = with_snippet(hits, reqs).select(
        F.col("id").alias("file_id"),
        M.text_of("filename").alias("filename"),
        M.text_of("extension").alias("extension"),
        M.text_of("filepath").alias("filepath"),
        F.when(F.col("snippet") == "", NAME_OR_PATH_TEXT).otherwise(F.col("snippet")).alias("snippet"),
        (F.coalesce(F.col("is_cloud"), F.lit(0)) != 0).alias("is_cloud"),
        M.relevance_of_match(reqs).alias("score"),
    )
    return top_k(hits, rank_order(), limit).select(*RESULT_COLUMNS)


def search_by_postings(
    files: DataFrame, postings: DataFrame, query: str, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """``search`` over the documents that hold all keys of the query, taken from the stored postings.

    The look-up reads the row groups of the query's keys alone. Its ids are written, and while they
    are few the catalog is cut to them by a broadcast before any text is tested.
    """
    spark = files.sparkSession
    asked = spark.sql("SELECT :query AS query FROM VALUES (1)", args={"query": query}).select(
        F.array_distinct(
            F.flatten(
                F.transform(X.requirements(F.col("query")), lambda r: P.requirement_keys(r["kind"], r["value"]))
            )
        ).alias("keys")
    )
    keys = asked.first()["keys"]
    if not keys:
        return search(files, query, limit)
    held = postings.filter(F.col("key").isin(*keys)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(held.filter(F.col("n") == len(keys)).select("id"))
    return search(files.join(found, "id", "left_semi"), query, limit)


def coarse_filter(reqs: list[M.Requirement]) -> Column:
    """Superset of the matches from substring tests on look-alike-folded lower case."""
    tests = []
    for r in reqs:
        if r.kind == "word":
            tests.append(M._any([F.lower(M.text_of(f)).contains(r.value) for f in M.FIELDS]))
        else:
            head = X.fold_lookalikes(F.lower(F.lit(leading_letters(r.value))))
            tests.append(
                M._any([X.fold_lookalikes(F.lower(M.text_of(f))).contains(head) for f in M.FIELDS])
            )
    return M._all(tests)


def leading_letters(code: str) -> str:
    """Letters a code starts with; its first two characters when it starts with a digit."""
    letters = code[: len(code) - len(code.lstrip("abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя"))]
    return letters or code[:2]


def search_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("results"), F.count_if("is_cloud").alias("cloud_results")
    )
