"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _to_minimum(adjacent: DataFrame, tables: common.Scratch) -> DataFrame:
    """Each (node, near) with the smallest of the node and all its neighbours.

    The minimum is aggregated before the shuffle and joined back from a stored table, so
    both sides of the join are plain: a small one is broadcast, and else the rows of a
    node with very many neighbours are split over several tasks.
    """
    least = adjacent.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return adjacent.join(tables.table(least, "least"), "node")


def large_star(edges: DataFrame, tables: common.Scratch) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
    found = _to_minimum(both, tables).where("near > node")
    return tables.table(found.select(F.col("near").alias("u"), F.col("least").alias("v")).where("u <> v"), "large")


def small_star(edges: DataFrame, tables: common.Scratch) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("near"))
    found = _to_minimum(down, tables)
    near = found.select(F.col("near").alias("u"), F.col("least").alias("v"))
    own = found.select(F.col("node").alias("u"), F.col("least").alias("v"))
    return tables.table(near.unionByName(own).where("u <> v").distinct(), "small")


def connected_components(edges: DataFrame, scratch: common.Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has columns u and v; loops, repeats and nulls are ignored.  Each star
    is written to the shared folder and the round before it removed; rounds end when the
    edges no longer change.  The result reads tables of ``scratch``.
    """
    rounds, before = common.Scratch(scratch.spark), None
    # stored first: a round reads its edges several times
    edges = rounds.table(edges.where("u <> v").select("u", "v"), "edges")
    for _ in range(max_rounds):
        edges = small_star(large_star(edges, rounds), rounds)
        rounds.drop(last=1)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.paths += rounds.paths
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
