"""Small scalar functions: attribute bits, routing, links, languages, manifests, JSON."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manualdex.functions import text as X
from manualdex.schema import (
    ATTRIBUTE_CLOUD_BITS,
    ATTRIBUTE_PINNED,
    ATTRIBUTE_UNREADABLE,
    EXTRACTABLE_EXTENSIONS,
    IMAGE_EXTENSIONS,
    OFFICE_EXTENSIONS,
    PLAIN_TEXT_EXTENSIONS,
)

# Search link, languages, manifest versions and messages.
WEB_SEARCH_PREFIX = "https://www.google.com/search?q="
LANGUAGES = ("ru", "uk", "en")
DEFAULT_LANGUAGE = "ru"
MANIFEST_FORMAT = "catalog-portable"
MANIFEST_DATABASE = "catalog.db"
MANIFEST_VERSION = 1
OLDEST_DATABASE_SCHEMA = 13
NOT_AN_OBJECT = "Manifest is not an object"
UNKNOWN_FORMAT = "Unknown backup format"
INVALID_VERSION = "Invalid backup version"
NEWER_VERSION = "Backup was created by a newer version"
OLD_SCHEMA = "Database schema is too old for direct mobile import"
NO_DATABASE = "Database file is not declared"


def is_extractable(extension: Column) -> Column:
    return F.coalesce(F.lower(extension), F.lit("")).isin(*EXTRACTABLE_EXTENSIONS)


def is_cloud(attributes: Column) -> Column:
    """Stored remotely: any remote bit set, unless pinned or unreadable."""
    remote = reduce(or_, [attributes.bitwiseAND(F.lit(bit)) != 0 for bit in ATTRIBUTE_CLOUD_BITS])
    pinned = attributes.bitwiseAND(F.lit(ATTRIBUTE_PINNED)) != 0
    return F.coalesce((attributes != ATTRIBUTE_UNREADABLE) & ~pinned & remote, F.lit(False))


def extract_route(extension: Column) -> Column:
    ext = F.coalesce(F.lower(extension), F.lit(""))
    return (
        F.when(ext == ".pdf", "pdf")
        .when(ext.isin(*OFFICE_EXTENSIONS), "office")
        .when(ext.isin(*PLAIN_TEXT_EXTENSIONS), "text")
        .when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .otherwise("none")
    )


def web_search_url(query: Column) -> Column:
    """Form-encoded search link; the JVM encoder differs for ``*`` and ``~``."""
    asked = X.strip(F.coalesce(query, F.lit("")))
    encoded = F.replace(
        F.replace(F.url_encode(asked), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )
    return F.when(asked == "", "").otherwise(F.concat(F.lit(WEB_SEARCH_PREFIX), encoded))


def normalize_language(language: Column) -> Column:
    code = F.replace(F.lower(X.strip(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-"))
    return (
        F.when(code.isin(*LANGUAGES), code)
        .when(code.startswith("uk") | code.startswith("ua"), "uk")
        .when(code.startswith("en"), "en")
        .when(code.startswith("ru"), "ru")
        .otherwise(DEFAULT_LANGUAGE)
    )


def _whole_number(parsed: Column, field: str) -> Column:
    """Value of an optional whole-number field: 0 when absent, null when unusable.
    Fractions are cut, numeric text is accepted, logical values count as 0 and 1."""
    item = F.try_variant_get(parsed, f"$.{field}", "variant")
    kind = F.schema_of_variant(item)
    text = F.try_variant_get(parsed, f"$.{field}", "string")
    trimmed = X.strip(text)
    return (
        F.when(item.isNull(), F.lit(0).cast("bigint"))
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .when(kind == "STRING", F.when(trimmed.rlike(r"\A[+-]?[0-9]+\z"), trimmed.try_cast("bigint")))
        .when(
            (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            text.try_cast("double").try_cast("bigint"),
        )
    )


def manifest_message(json: Column) -> Column:
    """First rule a backup manifest breaks, or ``OK``."""
    parsed = F.try_parse_json(json)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    declared = F.try_variant_get(parsed, "$.database_filename", "string")
    empty = F.coalesce(declared.isin("", "0", "false", "[]", "{}", "0.0"), F.lit(True))
    version = _whole_number(parsed, "backup_version")
    schema = _whole_number(parsed, "database_schema")
    return (
        F.when(~is_object, NOT_AN_OBJECT)
        .when(
            ~F.try_variant_get(parsed, "$.format", "string").eqNullSafe(F.lit(MANIFEST_FORMAT)),
            UNKNOWN_FORMAT,
        )
        .when(version.isNull() | schema.isNull(), INVALID_VERSION)
        .when(version > MANIFEST_VERSION, NEWER_VERSION)
        .when(schema < OLDEST_DATABASE_SCHEMA, OLD_SCHEMA)
        .when(empty, NO_DATABASE)
        .otherwise("OK")
    )


def manifest_json(
    database_schema: Column, created_utc: Column, app_version: Column, language: Column, root: Column
) -> Column:
    return F.to_json(
        F.struct(
            F.lit(MANIFEST_FORMAT).alias("format"),
            F.lit(MANIFEST_VERSION).alias("backup_version"),
            database_schema.cast("int").alias("database_schema"),
            F.date_format(created_utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_utc"),
            F.coalesce(app_version, F.lit("development")).alias("app_version"),
            F.coalesce(language, F.lit(DEFAULT_LANGUAGE)).alias("language"),
            F.coalesce(root, F.lit("")).alias("current_root"),
            F.lit(MANIFEST_DATABASE).alias("database_filename"),
        )
    )


def search_response(results: DataFrame, query: str) -> DataFrame:
    """One JSON response for the bounded results of a search."""
    item = F.struct("file_id", "filename", "extension", "snippet", "filepath", "is_cloud")
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return results.agg(
        F.to_json(
            F.struct(
                F.lit(query).alias("query"),
                F.count(F.lit(1)).alias("total"),
                F.transform(ordered, lambda r: r["item"]).alias("items"),
            )
        ).alias("response")
    )


def ask_response(question_sources: DataFrame, answer: Column) -> DataFrame:
    """One JSON response per question with its bounded list of sources."""
    sources = F.transform(
        "sources",
        lambda s, i: F.struct(
            F.concat(F.lit("S"), (i + 1).cast("string")).alias("source_id"),
            s["filename"].alias("filename"),
            s["filepath"].alias("filepath"),
            s["context"].alias("excerpt"),
        ),
    )
    return question_sources.select(
        "question_id",
        F.to_json(
            F.struct(
                answer.alias("answer"), sources.alias("sources"), F.lit(True).alias("local_only")
            )
        ).alias("response"),
    )
