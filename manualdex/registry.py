"""Registered queries and their SQL, collected from the area modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from manualdex.plans import registered

    out: dict[str, Query] = {}
    for part in registered.PARTS:
        out.update(part)
    return out


def all_oracles() -> dict[str, str]:
    from manualdex.oracle import statements

    out: dict[str, str] = {}
    for part in statements.PARTS:
        out.update(part)
    return out
