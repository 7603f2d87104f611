"""Connected components of links, as joins and grouped minima; no task holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.sources.shared import staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b; any ordered type): the smallest node that can be reached.

    Each round gives every node the smallest label around it and then the label of that label, so chains shorten to half
    and less a round. Links within a component of one label are dropped as they are found. Links with a null end and
    loops are ignored.
    """
    plain = links.select("a", "b").where("a <> b")
    edges = staged(plain.union(plain.select("b", "a")).distinct(), f"{name}-links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    while True:
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = staged(labels.join(to, "label").select("node", F.col("further").alias("label")), f"{name}-labels")
        own, other = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_ = edges.join(own, "a").join(other, "b").where("la <> lb")
        if open_.isEmpty():
            return labels.withColumnRenamed("label", "component")
        # Labels, not nodes, are hooked to smaller labels; their nodes follow.
        hooks = open_.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("low")).groupBy("label").agg(F.min("low").alias("low"))
        labels = labels.join(hooks, "label", "left").select("node", F.coalesce("low", "label").alias("label"))
