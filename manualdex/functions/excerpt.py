"""Excerpts around the first match of a pattern, counted in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from manualdex.functions import text as X


def anchor(text: Column, pattern: Column) -> Column:
    """``(start, length)`` of the first match, null where there is none.

    Cutting the text once at its first match gives both: what is missing between the two
    pieces is the match.
    """

    def measured(pieces: Column) -> Column:
        start, rest = F.char_length(F.get(pieces, F.lit(0))), F.char_length(F.get(pieces, F.lit(1)))
        return F.when(
            F.size(pieces) > 1,
            F.struct(start.alias("start"), (F.char_length(text) - start - rest).alias("length")),
        )

    return X.let(F.split(text, pattern, 2), measured)


def first_start(text: Column, pattern: Column) -> Column:
    """Position of the first match in characters, null where there is none."""
    return X.let(
        F.split(text, pattern, 2),
        lambda pieces: F.when(F.size(pieces) > 1, F.char_length(F.get(pieces, F.lit(0)))),
    )


def around(text: Column, hit: Column, radius: int, dots: bool) -> Column:
    """Text from ``radius`` characters before the match to ``radius`` after it."""
    start = F.greatest(F.lit(0), hit["start"] - radius)
    end = F.least(F.char_length(text), hit["start"] + hit["length"] + radius)
    body = X.one_line(F.substring(text, start + 1, end - start))
    if dots:
        body = F.concat(
            F.when(start > 0, "...").otherwise(""),
            body,
            F.when(end < F.char_length(text), "...").otherwise(""),
        )
    return F.when(hit.isNotNull(), body)
