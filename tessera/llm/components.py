"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stage


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's least node.

    A round gives every node the least label among itself and its neighbours, then the label of
    that label.  Hot nodes only meet in min() aggregates, which combine before they shuffle.  Every
    round is a written table, so a lost executor repeats one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage.keep(both, f"{name}-edges")
    labels = stage.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("label"))
        step = stage.keep(step, f"{name}-{k}")
        labels = step.select("node", "label")
        stage.drop(f"{name}-{k - 1}")
        if step.filter("label <> was").isEmpty():
            stage.drop(f"{name}-edges")
            return labels
