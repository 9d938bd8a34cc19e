"""Manifests, links, languages and schedules on hand-written cases."""

import datetime as dt
import json
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from manualdex.functions import scalars as Sc
from manualdex.functions import schedule as T
from tests.test_text import one

GOOD = {"format": Sc.MANIFEST_FORMAT, "backup_version": 1, "database_schema": 13, "database_filename": "a.db"}


@pytest.mark.parametrize(
    "manifest, message",
    [
        ([1], Sc.NOT_AN_OBJECT),
        ({}, Sc.UNKNOWN_FORMAT),
        ({**GOOD, "format": None}, Sc.UNKNOWN_FORMAT),
        ({**GOOD, "backup_version": "x"}, Sc.INVALID_VERSION),
        ({**GOOD, "backup_version": None}, Sc.INVALID_VERSION),
        ({**GOOD, "backup_version": "1.5"}, Sc.INVALID_VERSION),
        ({**GOOD, "backup_version": [1]}, Sc.INVALID_VERSION),
        ({**GOOD, "backup_version": 1.9}, "OK"),
        ({**GOOD, "backup_version": 2}, Sc.NEWER_VERSION),
        ({**GOOD, "database_schema": 12}, Sc.OLD_SCHEMA),
        ({k: v for k, v in GOOD.items() if k != "database_schema"}, Sc.OLD_SCHEMA),
        ({**GOOD, "database_filename": ""}, Sc.NO_DATABASE),
        ({k: v for k, v in GOOD.items() if k != "database_filename"}, Sc.NO_DATABASE),
        (GOOD, "OK"),
    ],
)
def test_manifest(spark, manifest, message):
    assert one(spark, Sc.manifest_message(F.lit(json.dumps(manifest)))) == message


@pytest.mark.parametrize("text", ["a b", "E10 код", "x*y~z", "a/b?c=d&e", " pad ", "100%", "'q\"(!)"])
def test_web_search_url(spark, text):
    assert one(spark, Sc.web_search_url(F.lit(text))) == Sc.WEB_SEARCH_PREFIX + quote_plus(text.strip())


def test_blank_web_search(spark):
    assert one(spark, Sc.web_search_url(F.lit("  "))) == ""


@pytest.mark.parametrize(
    "frequency, weekday, days, time, initial, base, want",
    [
        ("daily", 0, 1, "18:00", True, (2024, 1, 1, 10), (2024, 1, 1, 18)),
        ("daily", 0, 1, "18:00", True, (2024, 1, 1, 18), (2024, 1, 2, 18)),
        ("daily", 0, 1, "18:00", False, (2024, 1, 1, 10), (2024, 1, 2, 18)),
        ("weekly", 0, 1, "06:30", True, (2024, 1, 1, 5), (2024, 1, 1, 6, 30)),
        ("weekly", 0, 1, "06:30", False, (2024, 1, 1, 5), (2024, 1, 8, 6, 30)),
        ("weekly", 9, 1, "06:30", True, (2024, 1, 1, 5), (2024, 1, 7, 6, 30)),
        ("interval", 0, 3, "25:70", False, (2024, 1, 30, 5), (2024, 2, 2, 23, 59)),
        ("interval", 0, 0, "bad", True, (2024, 1, 1, 19), (2024, 1, 2, 18)),
        ("other", 0, 5, "00:00", False, (2024, 2, 28, 5), (2024, 2, 29)),
    ],
)
def test_next_due(spark, frequency, weekday, days, time, initial, base, want):
    got = one(
        spark,
        T.next_due(
            F.lit(dt.datetime(*base)).cast("timestamp_ntz"), F.lit(frequency), F.lit(weekday),
            F.lit(days), F.lit(time), F.lit(initial),
        ),
    )
    assert got == dt.datetime(*want)


def test_roll_forward_passes_now_unless_it_is_bounded(spark):
    args = [F.lit("daily"), F.lit(0), F.lit(1), F.lit("18:00")]
    start = F.lit(dt.datetime(2020, 1, 1, 18)).cast("timestamp_ntz")
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    assert one(spark, T.roll_forward(start, now, *args)) == dt.datetime(2024, 1, 1, 18)
    got = one(spark, T.roll_forward(start, now, *args, max_steps=400))
    assert got == dt.datetime(2020, 1, 1, 18) + dt.timedelta(days=400)
