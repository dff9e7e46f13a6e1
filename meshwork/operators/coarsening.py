"""Contraction of communities to the vertices of a smaller graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph
from meshwork.operators.ranks import dense_ids, places


def renumber(state: DataFrame) -> DataFrame:
    """(v, com, dense): communities numbered from 0 in order of their ids."""
    return state.select("v", "com").join(dense_ids(state, "com"), "com").select("v", "com", "dense")


def community_size(state: DataFrame) -> DataFrame:
    """(com, size)"""
    return state.groupBy("com").agg(F.count("*").alias("size"))


def community_degree_bound(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(com, degree): rows that start in the community."""
    return edges.join(state.select(F.col("v").alias("src"), "com"), "src").groupBy("com").agg(F.count("*").alias("degree"))


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w) between the labels of the ends; labels: (v, label). What lies within one is a self-loop."""
    a, b = labels.select(F.col("v").alias("src"), F.col("label").alias("sl")), labels.select(F.col("v").alias("dst"), F.col("label").alias("dl"))
    return edges.join(b, "dst").join(a, "src").groupBy(F.col("sl").alias("src"), F.col("dl").alias("dst")).agg(F.sum("w").alias("w"))


def community_degree_exact(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(com, degree): distinct neighbouring communities, the own one included where a row stays inside."""
    pairs = contract(edges, state.select("v", F.col("com").alias("label")))
    return pairs.groupBy(F.col("src").alias("com")).agg(F.count("*").alias("degree"))


def reorder(state: DataFrame) -> DataFrame:
    """(v, com, position): vertices by community, then by id."""
    return places(state.select("v", "com"), ["com", "v"], "position")


def coarsen(graph: Graph, state: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of communities, densely numbered, and the labels (v, label) that lead to it."""
    labels = renumber(state).select("v", F.col("dense").alias("label"))
    more = None if graph.more is None else labels.select(F.col("label").alias("v")).distinct()
    return Graph(contract(graph.edges, labels), more), labels
