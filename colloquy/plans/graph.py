"""Connected components, for records that may belong together through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.plans.runtime import has_rows, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component = smallest node.

    Each round takes the smallest label among neighbours and then jumps to the label's own
    label, so long chains shrink quickly. Lineage is cut every round.
    """
    both = materialize(edges.select("src", "dst").filter("src <> dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        .filter("src <> dst")).distinct())
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("_m")).select(
        F.col("src").alias("node"), F.least("src", "_m").alias("component")))
    while True:
        seen = labels.select(F.col("node").alias("dst"), F.col("component").alias("_c"))
        near = both.join(seen, "dst").groupBy(F.col("src").alias("node")).agg(
            F.min("_c").alias("_near"))
        moved = labels.join(near, "node").select(
            "node", F.least("component", "_near").alias("_c"), F.col("component").alias("_old"))
        if not has_rows(moved.filter("_c <> _old")):
            return labels
        jump = labels.select(F.col("node").alias("_c"), F.col("component").alias("_far"))
        labels = materialize(moved.join(jump, "_c", "left").select(
            "node", F.least("_c", F.coalesce("_far", "_c")).alias("component")))
