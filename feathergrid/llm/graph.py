"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``(a long, b long)``: root is the smallest node reachable.

    Each round takes the least label among the neighbours and then follows the
    label once more, so chains shorten by doubling.  Every round is written to
    the shared folder; nothing but a count comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct().where("a <> b"), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("told"))
        near = written(
            labels.join(told, labels["node"] == told["a"]).select("node", F.col("root").alias("old"), F.least("root", "told").alias("root")),
            "near",
        )
        above = near.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(near.join(above, "root").select("node", "old", F.least("root", "above").alias("root")), "labels")
        changed = jumped.where("root <> old").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
