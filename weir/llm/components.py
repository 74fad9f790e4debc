"""Connected components by alternating large and small stars: no component is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import stored


def _stars(edges: DataFrame, low: DataFrame) -> DataFrame:
    return edges.alias("e").join(low.alias("l"), F.col("e.u") == F.col("l.k"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node of its component.

    Self-loops, repeated and reversed edges don't matter; an edge with a null end is left out; no edges give no rows.
    Minima are pre-aggregated before each shuffle; the joins that follow are of kinds that AQE can split.
    """
    e = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = stored(e), None
    while True:
        # large star: every larger neighbour is tied to the least of a node's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("m", "k").alias("m"))
        e = _stars(both, low).filter("e.v > e.u").select(F.col("e.v").alias("u"), F.col("l.m").alias("v")).distinct()
        # small star: smaller neighbours are tied to the least of them
        low = e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        tied = _stars(e, low).filter("e.v <> l.m").select(F.col("e.v").alias("u"), F.col("l.m").alias("v"))
        e = stored(tied.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
