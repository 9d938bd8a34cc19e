"""Connected components of a link table, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manualdex.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) for every id in ``links`` (``a``, ``b``).

    Alternates the large-star and small-star steps: links are turned towards the smallest known
    neighbour until every component is a star around its smallest id, which takes about log(n) rounds. Each
    round is two grouped minimums and two joins; no neighbourhood is gathered in one row, and the smallest
    neighbour is combined on the map side, so a hub with a third of all links is no more than a hot join
    key, which adaptive execution splits. Links with a null end are ignored; an empty table gives no rows.
    """
    edges = cut_lineage(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above a node are linked to its smallest neighbour.
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        # Small star: a node's smaller neighbours are linked to the smallest of them, as the node is.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut_lineage(small.filter("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct())
    heads = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(heads)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down and no links up, or links up alone."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    wrong = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1")
    return wrong.isEmpty()
