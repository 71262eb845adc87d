"""Connected components of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the least node that can be reached.

    Each round, every node takes the least label among its neighbours' and its own,
    and then the label of that label, so chains shorten by doubling. Links are
    aggregated with map-side minima, so a node with many links is no hot spot.
    Ends when nothing changes; each round is written to the shared folder.
    """
    both = settle(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    )
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("of")).agg(F.min("seen").alias("seen"))
        least = labels.join(near, F.col("node") == F.col("of"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = settle(
            least.join(jump, F.col("label") == F.col("at"), "left").select(
                "node", "old", F.least("label", "further").alias("label")
            )
        )
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
