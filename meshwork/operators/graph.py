"""Graphs as frames: directed rows (src, dst, w), one row for a self-loop, and vertices (v)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.joins import HOT_PARTS
from meshwork.operators.ranks import prefix_sum
from meshwork.workspace import Workspace

#: A vertex with fewer rows is no hub, however small the graph.
HUB_ROWS = 1 << 16
#: Rows of a bucket, roughly.
BUCKET_ROWS = 1 << 22


@dataclass
class Graph:
    """edges: (src, dst, w), both directions; more: (v), vertices that are there even without edges."""

    edges: DataFrame
    more: DataFrame | None = None

    @property
    def vertices(self) -> DataFrame:
        """(v): all vertices. Both directions are there, so the rows' sources are all that have edges."""
        ends = self.edges.select(F.col("src").alias("v"))
        return (ends if self.more is None else ends.union(self.more.select("v"))).distinct()


def from_edges(pairs: DataFrame, symmetrize: bool = True, aggregate: bool = True, vertices: DataFrame | None = None) -> Graph:
    """A graph from pairs (a, b, w). Parallel rows are summed up when aggregate is set; unset it where there are none."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    if not symmetrize:
        ends = edges.select(F.col("dst").alias("v"))
        edges = added_up(edges) if aggregate else edges
        return Graph(edges, ends if vertices is None else ends.union(vertices))
    if aggregate:
        # before mirroring there are half as many rows to shuffle
        edges = added_up(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w"))
    return Graph(mirrored(edges), vertices)


def added_up(edges: DataFrame) -> DataFrame:
    """Parallel rows as one."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    """The rows and, except for self-loops, their mirror images, in one pass."""
    own = F.struct("src", "dst", "w")
    other = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(own)).otherwise(F.array(own, other))))


def lower_triangle(edges: DataFrame) -> DataFrame:
    """Only rows below the diagonal: the rule for files that call themselves general."""
    return edges.where("dst < src")


def mass(edges: DataFrame):
    """The sum of all directed weights, 0 for a graph without edges."""
    return edges.agg(F.sum("w")).first()[0] or 0


def summary(graph: Graph) -> DataFrame:
    """One row: vertices, edges (directed rows), mass."""
    return graph.vertices.agg(F.count("*").alias("vertices")).join(graph.edges.agg(F.count("*").alias("edges"), F.sum("w").alias("mass")))


def _per_vertex(graph: Graph, value, name: str) -> DataFrame:
    """(v, sum of value over the vertex's rows), 0 without rows: one aggregation, no join."""
    rows = graph.edges.select(F.col("src").alias("v"), value.alias(name))
    if graph.more is not None:
        rows = rows.union(graph.more.select("v", F.lit(0).cast(rows.schema[name].dataType)))
    return rows.groupBy("v").agg(F.sum(name).alias(name))


def vertex_weight(graph: Graph) -> DataFrame:
    """(v, k): the weighted degree, a self-loop counted once, 0 without edges."""
    return _per_vertex(graph, F.col("w"), "k")


def degrees(graph: Graph) -> DataFrame:
    """(v, degree): rows that start at the vertex."""
    return _per_vertex(graph, F.lit(1).cast("long"), "degree")


def csr_offsets(graph: Graph) -> DataFrame:
    """(v, degree, row_offset): rows before the vertex's first one, in order of the ids."""
    run = prefix_sum(degrees(graph), ["v"], "degree", "upto")
    return run.select("v", "degree", (F.col("upto") - F.col("degree")).alias("row_offset"))


@dataclass
class Dealt:
    """Edges written for many joins by dst: in buckets of dst, and apart the rows at hubs, of which there are at most HOT_PARTS.

    to_hub: rows into a hub from other vertices; from_hub: rows that start at one. All three are None where no vertex is a hub.
    """

    inner: DataFrame
    to_hub: DataFrame | None = None
    from_hub: DataFrame | None = None
    hubs: DataFrame | None = None

    def of_hubs(self, table: DataFrame, key: str) -> DataFrame:
        """The rows of a table at hubs, to be broadcast: at most HOT_PARTS of them where key is unique."""
        return F.broadcast(table.join(F.broadcast(self.hubs.select(F.col("hub").alias(key))), key, "left_semi"))

    def lookup(self, table: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows joined with a table by its unique dst: those that start at no hub, and those that do."""
        near = self.inner.join(table, "dst")
        if self.hubs is None:
            return near, None
        return near.unionByName(self.to_hub.join(self.of_hubs(table, "dst"), "dst")), self.from_hub.join(table, "dst")


def dealt(edges: DataFrame, work: Workspace, name: str) -> Dealt:
    """Written edges, dealt into buckets and hubs. A hub has over 1/HOT_PARTS of all rows, and over HUB_ROWS."""
    spark, total = edges.sparkSession, edges.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS)
    if total > HUB_ROWS:
        found = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB_ROWS, total // HOT_PARTS))
        hubs = work.put(f"{name}-hubs", found.select(F.col("src").alias("hub")))
        if not hubs.isEmpty():
            a, b = (F.broadcast(hubs.select(F.col("hub").alias(c))) for c in ("src", "dst"))  # at most HOT_PARTS rows
            others = edges.join(a, "src", "left_anti")
            return Dealt(
                work.buckets(f"{name}-inner", others.join(b, "dst", "left_anti").select(*edges.columns), n, "dst"),
                work.put(f"{name}-to", others.join(b, "dst", "left_semi").select(*edges.columns)),
                work.put(f"{name}-from", edges.join(a, "src", "left_semi").select(*edges.columns)),
                hubs,
            )
    return Dealt(work.buckets(f"{name}-inner", edges, n, "dst"))
