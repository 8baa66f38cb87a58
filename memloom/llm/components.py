"""Connected components of an edge table by alternating large and small stars.

Each round is two joins against per-node minima; a hub's rows stay splittable, because the minima
are aggregated map-side first and joined back. The edges of a round are written to the shared
folder, so nothing is recomputed when an executor is lost, and nothing is gathered on the driver
but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    to_low = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node it reaches.

    Loops and repeated edges are ignored; edges with a null end are dropped; no edges give no rows.
    """
    at = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
        .filter("x and y and u <> v")
        .select("u", "v")
        .distinct()
    )
    mark = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == mark:
            break
        mark = now
        new = cut(_star(_star(at, True).distinct(), False).distinct())
        drop_cut(at)
        at = new
    roots = at.select(F.col("v").alias("u"), "v").distinct()
    return at.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
