"""Connected components of a link table, by label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.session import fix


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node in ``links`` (a, b).

    Each round a node takes the smallest label among its neighbours (partially
    aggregated, so a hub costs one row per partition), labels are passed to the
    label's own node, and labels are followed once. Rounds are written tables.
    """
    both = fix(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = fix(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # the old label's node learns the new label, so whole trees move at once
        up = step.groupBy("old").agg(F.min("label").alias("um"))
        step = step.join(up.withColumnRenamed("old", "unode"), F.col("node") == F.col("unode"), "left").select("node", "old", F.least("label", F.coalesce("um", "label")).alias("label"))
        step = fix(step)
        jump = step.select(F.col("node").alias("jnode"), F.col("label").alias("far"))
        step = fix(step.join(jump, step["label"] == jump["jnode"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
