"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hot_join, written

ROUNDS = 60


def _nearest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v; a written table) with m, the least of u and its neighbours; a hot u of a star is summed up and joined without a shuffle."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    return hot_join(pairs, least, "u", "n").drop("n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is named by its least node.

    Every round hangs the larger neighbours of a node, then the smaller ones,
    on the least of them; the edges end as stars.  A round's edges are written
    to the shared folder.  Edges to the node itself or to null are no edges.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_nearest(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _nearest(large)
        e = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
