"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, old, root) for every node of ``edges`` (a, b); root is the component's smallest node, ``old`` the same.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so labels
    travel at least twice as far each round. Minima are pre-aggregated before they are shuffled. Labels are
    written to the shared folder each round; the driver sees one count per round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "components-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "components-labels")
    while True:
        near = both.join(labels.select("node", "root"), both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        step = step.join(up, step["root"] == up["up"], "left").select("node", "old", F.least("root", F.coalesce("up_root", "root")).alias("root"))
        step = materialize(step, "components-labels")
        discard(labels)
        if step.filter("old <> root").isEmpty():
            discard(both)
            return step
        labels = step
