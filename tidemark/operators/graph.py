"""Connected components by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import skew_safe_lookup
from tidemark.session import durable

JUMPS = 3  # label steps followed per round, on the table of labels only


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) with label = smallest id of the component.

    `nodes` has a column id, `edges` has (a, b) in both directions. Each round lowers a whole component to
    the smallest label next to it and then follows label chains one step further, so the number of rounds
    grows with the logarithm of the path length, not with the path. Every round is checkpointed.
    """
    state = durable(nodes.select("id", F.col("id").alias("label")))
    edges = durable(edges.select("a", "b"))
    while True:
        labels = state.select(F.col("id").alias("b"), F.col("label").alias("other"))
        nearby = edges.join(labels, "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("nearby"))
        best = (
            state.join(nearby, "id", "left")
            .groupBy("label")
            .agg(F.min(F.least("label", "nearby")).alias("best"), F.count(F.lit(1)).alias("members"))
        )
        best = durable(best)
        if best.filter("best < label").isEmpty():
            return state
        onward = best.select(F.col("label").alias("new_label"), F.col("best").alias("onward"))
        jumped = best.select("label", F.col("best").alias("new_label"), "members")
        for _ in range(JUMPS):
            jumped = jumped.join(onward, "new_label").select("label", F.col("onward").alias("new_label"), "members")
        state = durable(
            skew_safe_lookup(state, jumped, ["label"], "members").select("id", F.col("new_label").alias("label"))
        )
