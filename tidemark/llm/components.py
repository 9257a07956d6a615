"""Connected components of an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, component: the least node that it hangs together with; nodes without edges are absent.

    Each round hooks every node to its least neighbour, follows the hooks JUMPS times, and contracts the edges; what is
    left is solved the same way. Stars take one round, chains about the logarithm of their length.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "hooks")
        for _ in range(JUMPS):
            ahead = hooks.where("to <> node").select(F.col("node").alias("at"), F.col("to").alias("next"))
            hooks = materialize(hooks.join(ahead, hooks["to"] == ahead["at"], "left").select("node", F.coalesce("next", "to").alias("to")), "hooks")
        found.append(hooks)
        moved = hooks.where("to <> node")
        for end in ("a", "b"):
            step = moved.select(F.col("node").alias("at"), F.col("to").alias("next"))
            edges = edges.join(step, edges[end] == step["at"], "left").withColumn(end, F.coalesce("next", end)).select("a", "b")
        edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not found:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = found[-1]
    for hooks in reversed(found[:-1]):
        above = whole.select(F.col("node").alias("at"), F.col("to").alias("next"))
        whole = hooks.join(above, hooks["to"] == above["at"], "left").select("node", F.coalesce("next", "to").alias("to"))
    return materialize(whole.select("node", F.col("to").alias("component")), "components")
