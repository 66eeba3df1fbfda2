"""Connected components of distributed edges by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import Scope, scope, settle


def components(edges: DataFrame) -> DataFrame:
    """``k, c`` for every node of the edges ``a, b``: the nodes of a component share ``c``.

    Each round maps every node to its smallest neighbour (or itself) and replaces the edges by those between the images.
    Node keys are hashes, so a constant share of the nodes is left after a round even on long chains.
    """
    with scope(edges.sparkSession) as owner:
        return owner.keep(_contracted(edges, owner))


def _contracted(edges: DataFrame, owner: Scope) -> DataFrame:
    edges = settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = edges.select(F.col("a").alias("k"), F.col("b").alias("v")).union(edges.select("b", "a"))
        step = settle(both.groupBy("k").agg(F.min("v").alias("v")).select("k", F.least("k", "v").alias("c")))
        if found is None:
            found = step
        else:
            later = step.select(F.col("k").alias("c"), F.col("c").alias("next"))
            found = found.join(later, "c", "left").select("k", F.coalesce("next", "c").alias("c"))
        moved = (edges.join(step.select(F.col("k").alias("a"), F.col("c").alias("x")), "a")
                 .join(step.select(F.col("k").alias("b"), F.col("c").alias("y")), "b"))
        edges = settle(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        found = settle(found)
        owner.drop_all_but(edges, found)
        if edges.isEmpty():
            return found
