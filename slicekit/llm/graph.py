"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest
    node of its component.

    Each round hangs every node under the smallest neighbour of its larger and
    then of its smaller neighbours, until all components are stars.  Only edges
    move, each round's table is written to the shared folder, and the
    minimum of a node's neighbours is combined before the shuffle, so a node
    with very many edges costs no more than its edges do."""
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .filter("a <> b").distinct(), "components")
    state = _state(current)
    for _ in range(max_rounds):
        current = materialize(_small_star(_large_star(current)), "components")
        state, before = _state(current), state
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Tells two edge tables apart; a table of stars is its own successor."""
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
