"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import pin


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the least node reachable.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so labels travel twice as far every round.  Sums of a
    node's neighbours are combined map-side and both joins can be split by AQE,
    so a hub costs no single task.  Each round is a reliable checkpoint; only
    the number of changed nodes reaches the driver.  No links: no rows.
    """
    one_way = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    both = pin(one_way.union(one_way.select("dst", "src")).distinct())
    labels = pin(
        both.groupBy("src").agg(F.min("dst").alias("near"))
        .select(F.col("src").alias("node"), F.least("src", "near").alias("root"))
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("dst"), "root"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        )
        hop = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        # the label of that label, as of the last round
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        step = pin(hop.join(jump, "next").select(
            "node", F.least("next", "beyond").alias("new"), F.col("root").alias("old")))
        changed = step.filter("new <> old").limit(1).count()
        labels = step.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
