"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours (a grouped
    minimum, merged in each task first, so a node with very many links is
    one row a task) and then the label of that label, which halves chains. Rounds
    are written to the shared folder, so the lineage stays short.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        step = step.join(up, F.col("label") == F.col("up_node"), "left").select("node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label"))
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
