"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.session import cut, release


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link; ``links``: u, v.

    Alternates two steps until nothing changes: every node's larger neighbours are hung on the smallest
    node it sees, then its smaller neighbours are. Both are a minimum per node and a join, so no group is
    gathered; chains shorten by powers of two. Each round is a written table.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "components")
    mark, seen = _mark(edges), None
    while mark != seen:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        hung = star.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "components")
        release(edges)
        edges, seen, mark = new, mark, _mark(new)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
