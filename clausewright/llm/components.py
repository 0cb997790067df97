"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of itself and its neighbours: combined on the map
    side, so that a node with very many neighbours is no burden to one task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where(F.col("v") < F.col("u"))
    least = _least(down)
    leaves = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    """Order-free fingerprint of a set of edges; one row to the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, component) for each node that has an edge; component is its least node.

    Self-loops, repeated edges and either direction are fine; edges with a null
    end are left out. Nodes without edges don't come out (they are components
    of their own). Each round is written to the shared checkpoint folder, so a
    lost executor costs no more than one round.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut_lineage(e)
    last = _print_of(e)
    for _ in range(MAX_ROUNDS):
        e = cut_lineage(_small_star(_large_star(e)))
        now = _print_of(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
