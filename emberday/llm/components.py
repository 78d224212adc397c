"""Connected components as repeated joins and aggregates, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.session import release, written

MAX_ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in ``links``; component is the smallest id reachable.

    Alternates two star contractions: each node hands its larger neighbours, then its
    smaller ones, to the smallest id it knows. A round halves long chains, a hub of any
    degree only takes part in a ``min`` (combined before the shuffle) and a join whose hot
    key adaptive execution splits. Every round is written to the shared folder, so a lost
    executor re-reads files. Earlier rounds are deleted; the result is a written table. Links with a null end and self links are left out; repeated
    links count once; no links give no rows. Ids may be of any orderable type.
    """
    edges = _smaller_first(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    )
    edges = written(edges, "links")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges, before = written(_small_star(_large_star(edges)), "links"), edges
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled: every node but the smallest points straight at it
    named = edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    )
    table = written(named, "components")
    release(edges)
    return table


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one link only, to an id that has no smaller neighbour."""
    lowest = edges.groupBy("v").agg(F.count("*").alias("c"))
    inner = edges.select(F.col("u").alias("v")).distinct().withColumn("c", F.lit(1))
    return not lowest.unionByName(inner).groupBy("v").agg(F.sum("c").alias("c"), F.count("*").alias("k")).where(
        "c > 1"
    ).take(1)


def _smaller_first(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, linked to the smallest id around the node."""
    lowest = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    # a node without smaller neighbours is the smallest around itself
    return _smaller_first(
        edges.join(lowest, F.col("u") == F.col("n"), "left")
        .select(F.coalesce("m", "u").alias("u"), "v")
        .unionByName(lowest.select(F.col("m").alias("u"), F.col("n").alias("v")))
        .where(F.col("u") != F.col("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, linked to the smallest of them."""
    lowest = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    moved = edges.join(lowest, F.col("v") == F.col("n")).select(F.col("m").alias("x"), F.col("u").alias("y"))
    return _smaller_first(
        moved.where(F.col("x") != F.col("y"))
        .select(F.col("x").alias("u"), F.col("y").alias("v"))
        .unionByName(lowest.select(F.col("m").alias("u"), F.col("n").alias("v")))
    )
