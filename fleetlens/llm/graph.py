"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textkit as K


def _min_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each u is linked once and is no other's v: every node then hangs under a smallest one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that isn't the smallest of its component.

    Links, a table that can be read again, are kept as (u, v) with u > v. A round hangs every larger
    neighbour of a node under the smallest one it knows, then every smaller one; when only stars are
    left, each node is under its component's smallest node. Rounds are written to the shared folder,
    so lineage stays short. All work is grouped minima (combined before the shuffle) and equi joins.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_of(both).select("u", F.least("u", "m").alias("m"))
        # tables of links grow with the documents: merged, never broadcast; equal rows (no more than
        # there are links) go at the round's end
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _min_of(large)
        small = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = K.written(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
