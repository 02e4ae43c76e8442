"""Connected components of a link table that may be as large as the corpus."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)``: the least node that can be reached. Nodes without links are absent.

    A round offers every node its neighbours' labels (a minimum that is combined before the shuffle), then follows the
    own label one step further, so long chains shorten quickly. Rounds end when no label changed; their state lies
    in the shared checkpoint folder. Only that yes or no reaches the driver.
    """
    both = checkpointed(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
                        .unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    labels = checkpointed(both.groupBy("src").agg(F.min("dst").alias("least"))
                          .select(F.col("src").alias("node"), F.least("src", "least").alias("component")))
    while True:
        offers = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("component").alias("offer"))
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        moved = labels.join(further, "component", "left")
        stepped = checkpointed(moved.join(offers, moved.node == offers.dst).select(
            "node", F.col("component").alias("old"), F.least("component", "beyond", "offer").alias("component")))
        labels = stepped.select("node", "component")
        if stepped.filter("component <> old").isEmpty():
            return labels
