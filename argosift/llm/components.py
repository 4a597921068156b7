"""Connected components by alternating large-star and small-star, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, Scratch, attach


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours point to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("size")).filter("size > 0").hint("merge")
    return attach(both.filter("v > u"), least, "u", "size", total, SMALL_ROWS).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them; edges go from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).hint("merge")
    down = attach(edges, least, "u", "size", total, SMALL_ROWS)
    return down.select("u", F.col("m").alias("v")).unionByName(down.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every node of `edges` (a, b): component is the least id that can be reached.

    Loops, repeated edges and edges with a null end are allowed; the last two add nothing. No edges give no rows. Every round is
    a table in the shared folder; rounds grow with the logarithm of the number of nodes.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = scratch.put(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = scratch.put(_small(_large(now, mark[0]), mark[0]), "edges")
        scratch.drop(last)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
