"""Connected components by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, comp): comp is the smallest node reachable. Nodes without an edge to another don't appear.

    Every step writes its edges, so lineage stays short; each halves the
    distances at least, so the number of steps is logarithmic in a component's size.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: larger neighbours of u move to u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u move to the smallest of them
        large = materialise(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("u").alias("y"), "m")
        small = small.select(F.explode(F.array("x", "y")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, e = e, materialise(small)
        discard(old, large)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    found = materialise(out.unionByName(out.select(F.col("comp").alias("node"), "comp").distinct()))
    discard(e)
    return found
