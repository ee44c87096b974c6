"""Connected components by minimum labels with pointer jumping, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, comp) for every node of an edge; comp is the smallest node reachable.

    A round takes the smallest label among neighbours and then the label of that label, so chains shorten
    exponentially. A hub is a skewed join key of narrow rows; the minimum is combined before its shuffle.
    """
    both = ws.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), f"{name}-0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        best = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        jumped = best.join(labels.select(F.col("node").alias("to"), F.col("comp").alias("jump")), "to")
        new = ws.save(jumped.select("node", F.least("to", "jump").alias("comp"), (F.least("to", "jump") < F.col("was")).alias("moved")), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        labels = new.select("node", "comp")
        if not new.filter("moved").limit(1).count():
            ws.drop(f"{name}-edges")
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
