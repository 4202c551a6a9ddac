"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a long, b long).

    Alternating large-star and small-star steps: each rewires a node's neighbours to the smallest one, so stars form
    in a number of rounds that grows with the logarithm of the longest chain. Minima are aggregated map-side before
    the shuffle, and the rewiring join may be split by AQE where one node has very many neighbours. Each round is
    written to the shared folder, and the one before it removed. Links to itself and rows with a null end count for
    nothing, repeated ones once; an empty table gives none. Extra columns are not used.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        last = edges
        # large-star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: neighbours below a node, and the node, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        edges = stored(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(last)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
