"""Connected components of a table of links, by label propagation with shortcuts.

Every round each node takes the smallest label among its own and its neighbours', then the label of that label.  Labels are written to the
shared folder after each round, which cuts the lineage and survives lost executors.  Links are counted and joined by Spark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.sources.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` from ``a, b`` (longs): the label is the smallest node that can be reached; nodes without a link do not appear."""
    both = links.where("a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels["node"] == heard["a"], "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        further = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        moved = stored(told.join(further, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")), "labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels
