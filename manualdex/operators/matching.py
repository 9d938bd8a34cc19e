"""Which documents satisfy a query: requirement hits, context and model rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from manualdex.functions import text as X

# How early or how often a model must be mentioned in a text.
SINGLE_MODEL_POSITION = 1200
SINGLE_MODEL_MENTIONS = 2
BRAND_MODEL_POSITION = 8000
BRAND_MODEL_MENTIONS = 3
SCORE_NAME = 120
SCORE_PATH = 80
SCORE_CONTENT = 10
FIELDS = ("filename", "filepath", "content")


@dataclass(frozen=True)
class Requirement:
    kind: str
    value: str
    pattern: str
    fault: bool

    @property
    def probes(self) -> tuple[str, ...]:
        """Literal pieces any match must contain: digit runs of a code, or the word."""
        if self.kind == "tech":
            return tuple(re.findall("[0-9]+", self.value))
        return (self.value,)


@lru_cache(maxsize=8)
def _reader(application: str) -> Column:
    """Requirements of a column ``query``; built once, since the expression is large."""
    return F.transform(
        X.requirements(F.col("query")),
        lambda r: F.struct(
            r["kind"].alias("kind"),
            r["value"].alias("value"),
            X.requirement_pattern(r["kind"], r["value"]).alias("pattern"),
            ((r["kind"] == "tech") & X.is_fault(r["value"])).alias("fault"),
        ),
    ).alias("requirements")


def read_query(spark: SparkSession, query: str) -> list[Requirement]:
    """Requirements of one literal query, worked out by the Column functions."""
    # One literal row: the optimizer works it out, and no job runs.
    text = spark.sql("SELECT :query AS query FROM VALUES (1)", args={"query": query})
    found = text.select(_reader(spark.sparkContext.applicationId)).first()["requirements"]
    return [Requirement(r["kind"], r["value"], r["pattern"], r["fault"]) for r in found]


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts)


def text_of(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit(""))


def probe(field: str, req: Requirement) -> Column:
    """Cheap necessary condition, a plain substring test ahead of the pattern."""
    c = text_of(field)
    if req.kind == "word":
        c = F.lower(c)
    return _all([c.contains(p) for p in req.probes])


def hit(field: str, req: Requirement) -> Column:
    return probe(field, req) & text_of(field).rlike(req.pattern)


def requirement_hit(req: Requirement) -> Column:
    return _any([hit(f, req) for f in FIELDS])


def metadata_hit(req: Requirement) -> Column:
    return hit("filename", req) | hit("filepath", req)


def matches_all(reqs: list[Requirement]) -> Column:
    """Every requirement is met; a query without tokens matches nothing."""
    return _all([requirement_hit(r) for r in reqs]) if reqs else F.lit(False)


def all_in(field: str, reqs: list[Requirement]) -> Column:
    """Every requirement is met in one field; a query without tokens matches nothing."""
    return _all([hit(field, r) for r in reqs]) if reqs else F.lit(False)


def all_in_metadata(reqs: list[Requirement]) -> Column:
    return _all([metadata_hit(r) for r in reqs]) if reqs else F.lit(False)


def numeric_in_metadata(value: str) -> Column:
    """A number of three or more digits of the code stands alone in name or path."""
    numbers = [n for n in re.findall("[0-9]+", value) if len(n) >= 3]
    tests = [
        text_of(f).contains(n) & text_of(f).rlike(rf"(?U)(?<!\d){n}(?!\d)")
        for n in numbers
        for f in FIELDS[:2]
    ]
    return _any(tests) if tests else F.lit(False)


def mentions(field: Column, pattern: Column, cap: int = 3) -> Column:
    """Text cut at the first ``cap`` matches: its first piece gives the position of the
    first match in characters, its length the number of matches up to the cap."""
    return F.split(field, pattern, cap + 1)


def first_position(pieces: Column) -> Column:
    return F.char_length(F.element_at(pieces, 1))


def mention_count(pieces: Column) -> Column:
    return F.size(pieces) - 1


def context_rule(reqs: list[Requirement]) -> Column:
    """With a trailing fault code, some other part must name the equipment."""
    if len(reqs) >= 2 and reqs[-1].fault:
        return _any([metadata_hit(r) for r in reqs[:-1]])
    return F.lit(True)


def model_rule(reqs: list[Requirement]) -> Column:
    """A model found only in the text must be mentioned early or repeatedly."""
    models = [r for r in reqs if r.kind == "tech" and not r.fault]
    words = [r for r in reqs if r.kind == "word"]
    if len(reqs) == 1 and models:
        model = models[0]
        pieces = mentions(text_of("content"), F.lit(model.pattern))
        evidence = (mention_count(pieces) >= SINGLE_MODEL_MENTIONS) & (
            first_position(pieces) <= SINGLE_MODEL_POSITION
        )
        return metadata_hit(model) | numeric_in_metadata(model.value) | evidence
    if len(reqs) == 2 and len(models) == 1 and len(words) == 1:
        model = models[0]
        pieces = mentions(text_of("content"), F.lit(model.pattern))
        evidence = (mention_count(pieces) >= BRAND_MODEL_MENTIONS) | (
            (mention_count(pieces) >= 1) & (first_position(pieces) <= BRAND_MODEL_POSITION)
        )
        return metadata_hit(model) | evidence
    return F.lit(True)


def matches_query(reqs: list[Requirement]) -> Column:
    return matches_all(reqs) & context_rule(reqs) & model_rule(reqs)


def relevance(reqs: list[Requirement]) -> Column:
    """Score of any row: each requirement counts once, for its best field."""
    return sum(
        (
            F.when(hit("filename", r), SCORE_NAME)
            .when(hit("filepath", r), SCORE_PATH)
            .when(hit("content", r), SCORE_CONTENT)
            .otherwise(0)
            for r in reqs
        ),
        F.lit(0),
    )


def relevance_of_match(reqs: list[Requirement]) -> Column:
    """Score of a row already known to match: text is not searched again."""
    return sum(
        (
            F.when(hit("filename", r), SCORE_NAME)
            .when(hit("filepath", r), SCORE_PATH)
            .otherwise(SCORE_CONTENT)
            for r in reqs
        ),
        F.lit(0),
    )


def snippet_order(reqs: list[Requirement]) -> list[Requirement]:
    """A trailing fault code first, then codes, then words."""
    if not reqs:
        return []
    tail = [reqs[-1]] if reqs[-1].fault else []
    rest = reqs[: len(reqs) - len(tail)]
    return tail + [r for r in rest if r.kind == "tech"] + [r for r in rest if r.kind == "word"]
