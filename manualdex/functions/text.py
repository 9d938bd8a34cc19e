"""Tokens, technical codes and match patterns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, separators, stop words and look-alike letters.
LETTERS = "A-Za-zА-Яа-яЁё"
WORD_CHARS = "0-9A-Za-zА-Яа-яЁё"
TOKEN_PATTERN = r"([A-Za-zА-Яа-яЁё0-9._/+\\-]+)"
CODE_SEPARATOR = r"[\s\x1c-\x1f._/+\\-]*"
PREFIX_STOPWORDS = (
    "в", "на", "за", "от", "до", "по", "и", "или", "с", "со", "из", "для", "к", "о", "об", "про",
    "при", "год", "года", "in", "on", "at", "by", "of", "for", "to", "from", "and", "or", "with",
    "year",
)
CYRILLIC_LOOKALIKES = "АВСЕНКМОРТХавсенкмортх"
LATIN_LOOKALIKES = "ABCEHKMOPTXabcehkmoptx"

BLANK = r"[\s\x1c-\x1f]"
REQUIREMENT_TYPE = "array<struct<kind:string,value:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def is_blank(c: Column) -> Column:
    """Nothing but white space; stops at the first other character."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def has_stripped_chars(c: Column, n: int) -> Column:
    """``length(strip(c)) >= n`` without building the trimmed copy (n >= 2)."""
    ink = r"[^\s\x1c-\x1f]"
    return F.coalesce(c.rlike(rf"(?sU){ink}.{{{n - 2},}}{ink}"), F.lit(False))


def raw_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(1)), F.lower)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-zа-яё]+", "")


def is_tech(c: Column) -> Column:
    return (
        c.rlike(rf"\A[{WORD_CHARS}][{WORD_CHARS}._/+\\-]*\z")
        & c.rlike(f"[{LETTERS}]")
        & c.rlike("[0-9]")
    )


def is_fault(c: Column) -> Column:
    """One letter and one to four digits, e.g. a displayed fault code."""
    return c.rlike(rf"\A[{LETTERS}][0-9]{{1,4}}\z")


def fold_lookalikes(c: Column) -> Column:
    return F.translate(c, CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)


def code_groups(c: Column) -> Column:
    """Letter runs and digit runs of a compact code, in order."""
    return F.regexp_extract_all(c, F.lit(f"([{LETTERS}]+|[0-9]+)"), F.lit(1))


def merged_tokens(c: Column) -> Column:
    """Tokens with codes that were typed in pieces joined (``AC 35 L`` -> ``ac35l``).

    Each position first gets the word it would emit and the number of tokens that
    word covers; a fold then walks the array, skipping the covered positions.
    """

    def offer(token: Column, i: Column, words: Column) -> Column:
        head, number, tail = F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
        joins = (
            head.rlike(r"\A[a-zа-яё]{1,4}\z")
            & ~head.isin(*PREFIX_STOPWORDS)
            & F.coalesce(number.rlike(r"\A[0-9]+[a-zа-яё]*\z"), F.lit(False))
        )
        with_tail = joins & F.coalesce(tail.rlike(r"\A[a-zа-яё]{1,2}\z"), F.lit(False))
        return F.struct(
            F.when(with_tail, F.concat(head, number, tail))
            .when(joins, F.concat(head, number))
            .otherwise(token)
            .alias("word"),
            F.when(with_tail, 2).when(joins, 1).otherwise(0).alias("covers"),
        )

    def offers(tokens: Column) -> Column:
        return let(
            F.transform(tokens, compact),
            lambda words: F.transform(tokens, lambda t, i: offer(t, i, words)),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("words"), F.lit(0).alias("covers")
    )

    def step(state: Column, item: Column) -> Column:
        return F.when(
            state["covers"] > 0,
            F.struct(state["words"].alias("words"), (state["covers"] - 1).alias("covers")),
        ).otherwise(
            F.struct(
                F.concat(state["words"], F.array(item["word"])).alias("words"),
                item["covers"].alias("covers"),
            )
        )

    return F.aggregate(let(raw_tokens(c), offers), start, step, lambda s: s["words"])


def requirements(c: Column) -> Column:
    """Ordered ``(kind, value)`` requirements of a query; kind is ``tech`` or ``word``."""
    return F.transform(
        merged_tokens(c),
        lambda t: F.when(
            is_tech(t), F.struct(F.lit("tech").alias("kind"), compact(t).alias("value"))
        ).otherwise(F.struct(F.lit("word").alias("kind"), t.alias("value"))),
    )


def _either_letter(group: Column) -> Column:
    out = fold_lookalikes(F.lower(group))
    for cyr, lat in zip(CYRILLIC_LOOKALIKES[11:], LATIN_LOOKALIKES[11:]):
        out = F.replace(out, F.lit(lat), F.lit(f"[{lat}{cyr}]"))
    return out


def requirement_pattern(kind: Column, value: Column) -> Column:
    """Java regular expression that finds one requirement in a field.

    The first character is tried before its left edge is looked at, and letter case is
    ignored in the body only: almost every position of a text then fails on one comparison.
    """
    code = F.array_join(F.transform(code_groups(value), _either_letter), CODE_SEPARATOR)
    word = F.regexp_replace(value, f"([^{WORD_CHARS}])", r"\\$1")
    body = F.when(kind == "tech", code).otherwise(word)
    first, rest = (F.regexp_extract(body, r"(?s)\A(\[[^\]]*\]|\\.|.)(.*)\z", i) for i in (1, 2))
    open_end = (kind == "tech") & ~is_fault(value) & value.rlike(r"[0-9]\z")
    return F.concat(
        F.lit("(?iU:"),
        first,
        F.lit(rf")(?<![{WORD_CHARS}](?s:.))(?iU:"),
        rest,
        F.when(open_end, ")(?![0-9])").otherwise(f")(?![{WORD_CHARS}])"),
    )


def one_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def text_runs(c: Column) -> Column:
    """Distinct folded letter runs and digit runs of a text."""
    folded = fold_lookalikes(F.lower(c))
    return F.array_distinct(
        F.regexp_extract_all(folded, F.lit("[a-zа-яё]+|[0-9]+"), F.lit(0))
    )


def text_tokens(c: Column) -> Column:
    """Distinct alphanumeric tokens of a text, not folded."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit("[0-9a-zа-яё]+"), F.lit(0))
    )
