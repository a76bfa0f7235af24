"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): for every node of edges (a, b), the smallest node reachable.

    Each round takes the smallest label of the neighbours and then the label's
    own label, so long chains shrink by half a round. Minima are aggregated
    before the shuffle, labels are written to the shared folder each round, and
    only counts of changes come to the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    rows = both.count()
    for _ in range(max_rounds):
        near = spread_join(both, labels.select(F.col("node").alias("b"), "component"), ["b"], by="a", rows=rows).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = written(
            spread_join(lower, up, ["component"], by="node", how="left", rows=rows).select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component")),
            "labels",
        )
        labels = jumped.select("node", "component")
        if jumped.filter(F.col("was") != F.col("component")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
