"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node reachable) for every node of ``links`` (``a``, ``b``).

    Each round takes the least label among the neighbours and then the label of
    that label, so a path shrinks to a fraction of its length per round.  Labels
    go to a table in the shared folder after each round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("near")), "other")
        near = seen.groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(step.join(jump, "root", "left").select("node", "old", F.least("root", "next").alias("root")))
        labels = moved.select("node", "root")
        if moved.filter("root != old").isEmpty():
            return labels
