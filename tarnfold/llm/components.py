"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import deleted, salted_join, stored, written


def _stars(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One round. A node's smallest neighbour is an aggregate with map-side combine, joined back with the rows of hot nodes dealt out: no neighbour list is ever built, and the centre of a large star is no hot key."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not larger:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    hung = salted_join(both, least, ["u"], F.col("v"), 2 * total)
    if larger:
        out = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the smallest node that it reaches.

    Nulls and self-links are dropped, repeated and reversed edges count once; no edges give no rows.
    Each round is written to the shared folder, so a lost executor repeats one round at most; the round before it is then deleted.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        stars, half = written(_stars(now, True, seen[0]), "stars")
        then, after = written(_stars(stars, False, stars.count()), "stars")
        for done in (path, half):
            deleted(spark, done)
        now, path = then, after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    held = stored(out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    deleted(spark, path)
    return held
