"""Connected components by joins: least labels with pointer jumping, a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import checkpoint, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (x, y): the least node that it reaches.

    A round takes for each node the least label among its neighbours' (summed before the shuffle, so a node with
    very many links is no hot spot), then the label of that label. Rounds grow with the logarithm of the longest path.
    """
    rows = 2 * links.count()
    pairs = links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct()
    pairs = checkpoint(pairs, "pairs", rows)
    now = pairs.groupBy("x").agg(F.min("y").alias("c")).select(F.col("x").alias("node"), F.least("x", "c").alias("c"))
    now = checkpoint(now, "labels", rows)
    while True:
        near = pairs.join(now.withColumnsRenamed({"node": "y"}), "y").groupBy("x").agg(F.min("c").alias("near")).withColumnRenamed("x", "node")
        step = now.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("c").alias("far"))
        step = step.join(jump, "c", "left").select("node", "old", F.least("c", "far").alias("c"))
        new = checkpoint(step, "labels", rows)
        done = new.where("c <> old").isEmpty()
        drop(now)
        now = new.select("node", "c")
        if done:
            drop(pairs)
            return now.withColumnRenamed("c", "component")
