"""Layout diagnostics: degree bins, edge-balanced ranges of vertices, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scores import degree_bin
from meshwork.operators.graph import Graph, csr_offsets
from meshwork.operators.ranks import places
from meshwork.workspace import Workspace


def degree_bins(degrees: DataFrame, kind: str) -> DataFrame:
    """(bin, vertices, max_degree) of the bins that have vertices. degrees: rows with a column degree."""
    return degrees.groupBy(degree_bin(F.col("degree"), kind).alias("bin")).agg(F.count("*").alias("vertices"), F.max("degree").alias("max_degree"))


def bin_order(degrees: DataFrame, kind: str) -> DataFrame:
    """(v, bin, position): vertices bin by bin, in order of their ids within a bin; the first of a bin is its offset."""
    return places(degrees.select("v", degree_bin(F.col("degree"), kind).alias("bin")), ["bin", "v"], "position")


def edge_partition(graph: Graph, parts: int) -> DataFrame:
    """(part, first_edge, first_vertex): part p begins at the vertex whose rows hold row p * (E div P) + min(p, E mod P)."""
    rows = csr_offsets(graph)
    total = rows.agg(F.sum("degree")).first()[0] or 0
    starts = [(p, p * (total // parts) + min(p, total % parts)) for p in range(parts)]
    bounds = F.broadcast(graph.edges.sparkSession.createDataFrame(starts, "part int, first_edge long"))  # one row for each part
    return rows.join(bounds, (F.col("row_offset") <= F.col("first_edge")) & (F.col("first_edge") < F.col("row_offset") + F.col("degree"))).select("part", "first_edge", F.col("v").alias("first_vertex"))


def locate(graph: Graph, parts: int) -> DataFrame:
    """(v, part, local_id): the last part that begins at or before the vertex, and the vertex's place in it."""
    work = Workspace(graph.edges.sparkSession, "locate")
    placed = work.put("placed", places(graph.vertices, ["v"], "place"))
    starts = sorted(r.first_vertex for r in edge_partition(graph, parts).collect())  # one number for each part
    owner = F.size(F.filter(F.lit(starts[1:]).cast("array<bigint>"), lambda first: F.col("v") >= first))
    owned = placed.select("v", owner.cast("int").alias("part"), "place")
    lowest = F.broadcast(owned.groupBy("part").agg(F.min("place").alias("low")))  # one row for each part
    return owned.join(lowest, "part").select("v", "part", (F.col("place") - F.col("low")).alias("local_id"))


def even_partition(communities: DataFrame, column: str, parts: int) -> DataFrame:
    """(column, part): C communities in order, C div P to a part, and one more for each of the first C mod P."""
    ranked = places(communities.select(column).distinct(), [column], "place")
    total = ranked.count()
    size, more = divmod(total, parts)
    place, big = F.col("place"), more * (size + 1)
    part = F.when(place < big, F.floor(place / (size + 1))).otherwise(more + F.floor((place - big) / max(size, 1)))
    return ranked.select(column, part.cast("int").alias("part"))
