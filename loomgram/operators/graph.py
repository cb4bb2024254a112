"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgram.tables import keep


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round joins the edges with the smallest neighbour of each node and writes them to the shared folder. The
    number of rounds is logarithmic in the longest path. Minima are written before they are joined, so that both
    sides of each join come from a shuffle and AQE can split a hot centre. Loops and null ends are left out.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    e = keep(e.where("a <> b").distinct())
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct())
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
