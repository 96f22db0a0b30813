"""Connected components of links between nodes, by rounds of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.workers import removed_at_exit, shared_folder


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) is connected with.

    Each round every node hangs itself and its larger neighbours on the least node that it
    knows, alternately over all and over smaller neighbours, until links form stars. Rounds
    grow with the logarithm of the nodes, and each is written to the shared folder, so that a
    lost executor costs no more than a round. Nothing is gathered for a node: the least
    neighbour is an aggregate, so a node with very many links is no burden.
    """
    spark = links.sparkSession
    top = removed_at_exit(f"{shared_folder(spark)}/components-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    def hung(edges: DataFrame, smaller_only: bool) -> DataFrame:
        """Links (a > b) after one half of a round."""
        both = edges if smaller_only else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        near = both.join(least, "a")
        if smaller_only:
            moved = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        else:
            moved = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    known, k = None, 0
    while True:
        k += 1
        edges = written(hung(hung(edges, False), True), str(k))
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == known:
            break
        known = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
