"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label, was): the smallest node of each component, for every node that has an edge.

    edges: (a, b), in either direction, repeated or not. Labels fall to the smallest label next to them and then to
    the label of their label, until none changes; each round is a written table, so that lineage stays short.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumn("was", F.col("label")), "labels")
    while True:
        near = both.join(labels.drop("was"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.drop("was").join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        lower = lower.join(jump, "next", "left").select("node", F.col("label").alias("was"), F.least("next", "beyond").alias("label"))
        before, labels = labels, written(lower, "labels")
        forget(before)
        if labels.filter("label < was").isEmpty():
            forget(both)
            return labels
