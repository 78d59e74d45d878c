"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written


def _large(e: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to its least neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Links each node's smaller neighbours, and itself, to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); component is the least node reachable.

    Loops, repeated edges and either direction are fine; nodes without edges don't appear,
    except those of loops, and an empty table gives an empty result. Every round is written,
    so a lost executor costs one round.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    last = None
    for _ in range(rounds):
        e = written(_small(_large(e)), "components")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") <= F.col("b"))).first()
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError("components did not converge")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
