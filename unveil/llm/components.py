"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.llm.shared import stored, with_group


def _pull(pairs: DataFrame, own_too: bool) -> DataFrame:
    """Ties every neighbour of a node to the least id around the node.

    ``pairs`` (u, v) lists for each node u the neighbours to look at. The
    least id is a partial aggregate and joins back on u, so a node that
    touches a third of all edges is split by the skew join.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = with_group(pairs, least, "u")
    kept = near if own_too else near.where("v > u")
    out = kept.where("v != m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    if own_too:
        out = out.unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge names.

    component is the least node id reachable. Edges need no order and may
    repeat; loops and nulls are left out. Every round is written to the shared
    folder; the driver sees a count and a checksum per round. The number of
    rounds grows with the logarithm of the longest path; running out of
    rounds raises.
    """
    now = stored(edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _pull(both, own_too=False)
        now = stored(_pull(large.select(F.col("a").alias("u"), F.col("b").alias("v")), own_too=True), "cc")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
