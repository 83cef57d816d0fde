"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: u > v. Links every (large: greater, else: smaller) neighbour of a node, and the node, to the smallest of them.

    Only the smallest neighbour of each node is aggregated (with partial sums), and it is joined back to the edges, so no node's neighbours are gathered in one place.
    """
    if large:
        sides = edges.union(edges.select("v", "u")).toDF("node", "near")
    else:
        sides = edges.toDF("node", "near")
    least = sides.groupBy("node").agg(F.min("near").alias("low")).withColumn("low", F.least("node", "low"))
    met = sides.join(least, "node")
    if large:
        out = met.where("near > node").select(F.col("near").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.col("near").alias("u"), F.col("low").alias("v")).union(least.select("node", "low"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every node of ``links`` (columns u, v of one orderable type) but the roots: root is the smallest node reachable.

    Null ends and self-links are left out; repeated links and both directions count once. Each round is written to the shared folder, so losing an executor never costs more than one round.
    """
    links = links.where("u is not null and v is not null and u <> v")
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = written(_star(edges, True))
        after = written(_star(large, False))
        forget(edges, large)
        edges, before = after, state
        state = _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select("u", F.col("v").alias("root"))
