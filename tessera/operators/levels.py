"""Loops over DataFrames that can die and go on: a table for each level, committed by its success marker.

A level is made from the one before and written to ``level=<k>``.  A loop that starts on a folder with
committed levels goes on after the last of them; a level that was cut off is written anew.  Tables
before the last two are deleted as the loop goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files


class Levels:
    def __init__(self, spark: SparkSession, folder: str, keep: int | None = 2):
        """``keep`` levels stay; None keeps all."""
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def committed(self) -> list[int]:
        found = [n for n in files.names(self.spark, self.folder) if n.startswith("level=")]
        return sorted(int(n.split("=")[1]) for n in found if files.exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))

    def table(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/level={level}")

    def _commit(self, level: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/level={level}")
        for n in self.committed()[: -self.keep] if self.keep else []:
            files.delete(self.spark, f"{self.folder}/level={n}")
        return self.table(level)

    def run(self, first: Callable[[], DataFrame], step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool]) -> DataFrame:
        """The level for which ``done`` holds; ``step`` makes the next one."""
        known = self.committed()
        level = known[-1] if known else 0
        rows = self.table(level) if known else self._commit(0, first())
        while not done(rows):
            level += 1
            rows = self._commit(level, step(rows))
        return rows

    def clear(self) -> None:
        files.delete(self.spark, self.folder)


def components(edges: DataFrame, levels: Levels) -> DataFrame:
    """(node, component): the least node that a node reaches through what it shares; edges are (node, hub).

    Labels go from nodes to hubs and back as minima, which combine before the shuffle, so that a hub with very many
    nodes is a sum of small ones.  A level says how many labels changed.
    """
    def first():
        return edges.select("node").distinct().select("node", F.col("node").alias("component"), F.lit(True).alias("changed"))

    def step(labels):
        # merge joins: a level's small tables would else be broadcast through the driver, level by level
        hubs = edges.join(labels.select("node", "component").hint("merge"), "node").groupBy("hub").agg(F.min("component").alias("component"))
        near = edges.join(hubs.hint("merge"), "hub").groupBy("node").agg(F.min("component").alias("least"))
        least = F.least("component", F.coalesce("least", "component"))
        return labels.join(near.hint("merge"), "node", "left").select("node", least.alias("component"), (least < F.col("component")).alias("changed"))

    return levels.run(first, step, lambda rows: rows.filter("changed").isEmpty()).select("node", "component")
