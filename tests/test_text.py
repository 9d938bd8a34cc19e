"""Tokens, codes and patterns: hand-written cases and Python ``re`` as a second opinion."""

import re

import pytest
from pyspark.sql import functions as F

from manualdex.functions import questions as Qn
from manualdex.functions import text as X
from manualdex.operators import matching as M


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "query, tokens",
    [
        ("AC 35L", ["ac35l"]),
        ("AC 35 L", ["ac35l"]),
        ("КС 55724", ["кс55724"]),
        ("ОНК 160", ["онк160"]),
        ("RT 100", ["rt100"]),
        ("КС 55724 в", ["кс55724в"]),
        ("на 35", ["на", "35"]),
        ("PAT DS350 E15", ["pat", "ds350", "e15"]),
        ("код 77", ["код77"]),
        ("ошибка 1234", ["ошибка", "1234"]),
        ("", []),
        ("  -  ", ["-"]),
        ("подія їжак", ["под", "я", "жак"]),
    ],
)
def test_merged_tokens(spark, query, tokens):
    assert one(spark, X.merged_tokens(F.lit(query))) == tokens


@pytest.mark.parametrize(
    "code, groups",
    [
        ("ac35l", ["ac", "35", "l"]),
        ("ds350", ["ds", "350"]),
        ("онк160", ["онк", "160"]),
        ("e15", ["e", "15"]),
    ],
)
def test_code_groups(spark, code, groups):
    assert one(spark, X.code_groups(F.lit(code))) == groups


@pytest.mark.parametrize(
    "query, text, expected",
    [
        ("ac35l", "AC35L AC 35L AC-35-L ac/35l", True),
        ("ac35l", "A C 3 5 L", False),
        ("ds350", "see DS350GW", True),
        ("ds350", "see DS3500", False),
        ("ds350", "xDS350", False),
        ("e15", "E15B", False),
        ("e15", "E 15.", True),
        ("e10", "код Е10", True),
        ("онк160с", "OHK-160C", True),
        ("pat", "compatible", False),
        ("pat", "(PAT)", True),
        ("e10", "E 10", True),
        ("ПРИВЕТ", "привет", True),
    ],
)
def test_patterns(spark, query, text, expected):
    req = M.read_query(spark, query)[0]
    assert one(spark, F.lit(text).rlike(req.pattern)) is expected
    python_form = req.pattern.replace("(?iU:", "(?i:")
    assert bool(re.search(python_form, text)) is expected


def test_fault_and_kind(spark):
    reqs = M.read_query(spark, "PAT DS350 E15")
    assert [(r.kind, r.value, r.fault) for r in reqs] == [
        ("word", "pat", False),
        ("tech", "ds350", False),
        ("tech", "e15", True),
    ]


@pytest.mark.parametrize(
    "question, query",
    [
        ("На ОНК-160С появляется E10. Что проверить?", "онк160с e10"),
        ("Terex AC35L не работает телескопирование", "terex ac35l"),
        ("PAT DS350 E15 что значит", "pat ds350 e15"),
        ("ошибка 1234 на DS350", "1234 ds350"),
        ("how to check гидроаккумулятор", "гидроаккумулятор"),
        ("  ", ""),
        (None, ""),
    ],
)
def test_search_plan(spark, question, query):
    plan = one(spark, Qn.search_plan(F.lit(question).cast("string")))
    assert plan["search_query"] == query


def test_strip_and_lengths(spark):
    assert one(spark, X.strip(F.lit("\n  a b\t\x1f"))) == "a b"
    assert one(spark, F.char_length(F.trim(F.lit("\n" * 10)))) == 10
    assert one(spark, X.strip(F.lit("\n" * 10))) == ""
    for text in ("", "a", "123456789", "1234567890", "  12345 7890 ", "\n" * 12):
        want = len(text.strip()) >= 10
        assert one(spark, X.has_stripped_chars(F.lit(text), 10)) is want
