"""Connected components by alternating large and small stars.

Every round is two grouped minima and two joins over the edge table; each step
is a written table, so a lost executor repeats one step only. Labels converge in
O(log^2 n) rounds whatever the shape of the components. Nothing is collected but
three numbers a round, which tell whether the edges still change.

A node with many neighbours is one key of the minima (pre-aggregated before the
shuffle) and of the joins, whose sides are plain table scans, so that the
adaptive skew join can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).collect()[0]
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node, component)``, component the smallest node reachable.

    Null ends, self links and repeated edges are ignored; nodes without an edge
    do not appear. An empty edge table gives an empty result.
    """
    clean = edges.where("u is not null and v is not null and u <> v")
    e = clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # large star: every larger neighbour of u is linked to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
