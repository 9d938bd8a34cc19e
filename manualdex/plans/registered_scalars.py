"""Registered queries over scalar functions, schedules, manifests and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from manualdex.functions import scalars as Sc
from manualdex.functions import schedule as T
from manualdex.plans import assist as A
from manualdex.plans import search as S
from manualdex.sources import derived as D


def _next_due(spark, sf):
    c = F.col
    return D.schedules(spark, sf).select(
        "id",
        T.next_due(
            c("base"), c("frequency"), c("weekday"), c("interval_days"), c("time"), c("initial")
        ).alias("next_due"),
    )


def _roll_forward(spark, sf):
    c = F.col
    rows = D.schedules(spark, sf).withColumn(
        "now", c("base") + F.make_dt_interval((c("id") % 700).cast("int"), (c("id") % 24).cast("int"))
    )
    return rows.select(
        "id",
        T.roll_forward(
            c("base"), c("now"), c("frequency"), c("weekday"), c("interval_days"), c("time")
        ).alias("next_due"),
    )


def _schedule_action(spark, sf):
    c = F.col
    return D.settings(spark, sf).select(
        "id",
        T.schedule_action(
            T.parse_bool(c("enabled")), c("next_due"), c("now"),
            T.parse_bool(c("run_overdue"), True), c("startup"),
        ).alias("action"),
    )


def _lenient_casts(spark, sf):
    c = F.col
    return D.settings(spark, sf).select(
        "id",
        T.parse_bool(c("enabled")).alias("enabled_or_false"),
        T.parse_bool(c("enabled"), True).alias("enabled_or_true"),
        T.parse_timestamp(c("next_due")).alias("due"),
        T.show_timestamp(T.parse_timestamp(c("next_due"))).alias("shown"),
    )


def _manifest_check(spark, sf):
    message = Sc.manifest_message(F.col("json"))
    return D.manifests(spark, sf).select("id", message.alias("message")).withColumn(
        "ok", F.col("message") == "OK"
    )


def _manifest_json(spark, sf):
    return D.settings(spark, sf).select(
        "id",
        Sc.manifest_json(
            (F.col("id") % 40), F.col("now"), F.lit(None).cast("string"),
            Sc.normalize_language(F.col("language")), F.lit("/lib"),
        ).alias("manifest"),
    )


def _ask_response(spark, sf):
    planned = A.plan_questions(D.questions(spark, sf))
    sources = A.question_sources(D.texts(spark, sf), planned, frequent=D.frequent_keys(spark, sf))
    return Sc.ask_response(sources, F.lit(""))


SCALARS = {
    "extractable_flag": lambda spark, sf: D.catalog(spark, sf).select(
        "id", Sc.is_extractable(F.col("extension")).alias("extractable")
    ),
    "cloud_flag": lambda spark, sf: D.attributes(spark, sf).select(
        "filepath", Sc.is_cloud(F.col("attributes")).alias("is_cloud")
    ),
    "extract_route": lambda spark, sf: D.catalog(spark, sf).select(
        "id", Sc.extract_route(F.col("extension")).alias("route")
    ),
    "next_due": _next_due,
    "roll_forward_due": _roll_forward,
    "schedule_action": _schedule_action,
    "lenient_casts": _lenient_casts,
    "web_search_url": lambda spark, sf: D.questions(spark, sf).select(
        "question_id", Sc.web_search_url(F.col("question")).alias("url")
    ),
    "normalize_language": lambda spark, sf: D.settings(spark, sf).select(
        "id", Sc.normalize_language(F.col("language")).alias("language")
    ),
    "validate_manifest": _manifest_check,
    "manifest_json": _manifest_json,
    "search_response_json": lambda spark, sf: Sc.search_response(
        S.search(D.texts(spark, sf), "ac 35 l", S.REQUEST_LIMIT), "ac 35 l"
    ),
    "ask_response_json": _ask_response,
}

PARTS = [SCALARS]
