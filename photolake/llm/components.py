"""Connected components of an edge table by alternating large-star and small-star rounds, all as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    ``edges`` has columns a, b (long, undirected, repeats and loops allowed). Nodes without an edge are not returned.
    Each round is written to the shared folder, so no lineage grows and a lost executor costs one round.
    An empty edge table gives an empty result.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("u"), F.col("v"), "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, written(small.select("e.*").where("u <> v").distinct(), "edges")
        discard(last)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
