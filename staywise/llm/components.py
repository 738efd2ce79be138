"""Connected components of a link table by alternating large-star and small-star steps.

A step is a minimum per node (map-side combined, so a hub is no hot key) and a join. Every step is staged, so lineage stays short
and lost executors cost one step. The number of steps grows with the logarithm of the longest chain.
"""
from pyspark.sql import functions as F

from .tables import stage

ROWS_PER_FILE = 200_000


def _step(edges, large):
    """One star step over edges (u, v), u > v, without repeats."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _digest(edges):
    r = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links):
    """(node, root): every node of ``links`` (a, b) with the smallest node it reaches. No links give no rows."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    before = None
    while (now := _digest(edges)) != before:
        before, files = now, 1 + now[0] // ROWS_PER_FILE
        edges = stage(_step(edges, large=True).coalesce(files), "large-star")
        edges = stage(_step(edges, large=False).coalesce(files), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
