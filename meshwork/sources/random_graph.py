"""A random graph, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, added_up, mirrored

SCALE = 1_000_000


def random_graph(spark: SparkSession, n: int = 40, sparsity: float = 0.1, seed: int = 0, symmetrize: bool = True) -> Graph:
    """Each ordered pair, self-loops too, draws x from 0 to SCALE - 1 and is an edge of weight 1 + x / SCALE iff x < SCALE * sparsity.

    symmetrize=False keeps the directed rows; else mirror images are added and parallel rows summed up. x comes from the first 32 bits of
    the MD5 of seed and pair, so the graph does not depend on partitions.
    """
    pairs = spark.range(n * n).select((F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % SCALE).alias("x"))
    edges = pairs.where(F.col("x") < int(SCALE * sparsity)).select("src", "dst", (1 + F.col("x") / SCALE).alias("w"))
    if symmetrize:
        edges = added_up(mirrored(edges))
    return Graph(edges, spark.range(n).select(F.col("id").alias("v")))
