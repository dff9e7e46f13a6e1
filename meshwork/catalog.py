"""All registered queries of the graph engine, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork import sql
from meshwork.operators import coarsening, communities, layout
from meshwork.operators import graph as G
from meshwork.operators.cliques import Cliques, cliques
from meshwork.operators.ranks import dense_ids
from meshwork.plans.louvain import louvain
from meshwork.sources.matrix_market import read_entries, read_mtx, write_entries, write_mtx
from meshwork.sources.projections import projection, table, user_slots
from meshwork.sources.random_graph import random_graph
from meshwork.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
#: A general file with entries above, on and below the diagonal.
GENERAL = "%%MatrixMarket matrix coordinate real general\n% comment\n4 4 6\n1 1 5.0\n2 1 1.5\n1 2 9.0\n3 1 2.0\n4 3 0.5\n2 4 7.0\n"
#: A symmetric file: the diagonal counts once, and every weight is 1.
SYMMETRIC = "%%MatrixMarket matrix coordinate real symmetric\n%\n\n4 4 5\n1 1 5.0\n2 1 2.0\n3 2 4.0\n3 2 1.5\n4 1 0.5\n"
#: Complex entries.
COMPLEX = "%%MatrixMarket matrix coordinate complex general\n2 3 3\n1 1 1.5 -2\n2 3 0 4.25\n1 2 -3 0\n"
TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]


def edges_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "ps").edges


def edges_lower_triangle(spark: SparkSession, d: str) -> DataFrame:
    return G.lower_triangle(projection(spark, d, "nt").edges)


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(_graph(spark, d, "po"))


def total_mass(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "po").edges.agg(F.sum("w").alias("mass"))


def vertex_weight(spark: SparkSession, d: str) -> DataFrame:
    return G.vertex_weight(projection(spark, d, "po"))


def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return G.csr_offsets(projection(spark, d, "po"))


def degree_bins_move(spark: SparkSession, d: str) -> DataFrame:
    return layout.degree_bins(G.degrees(projection(spark, d, "po")), "move")


def degree_bins_symbolic(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _swept(spark, d, "po")
    return layout.degree_bins(coarsening.community_degree_bound(graph.edges, state), "symbolic")


def degree_bins_numeric(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _swept(spark, d, "ps")
    return layout.degree_bins(coarsening.community_degree_exact(graph.edges, state), "numeric")


def edge_partition_4(spark: SparkSession, d: str) -> DataFrame:
    return layout.edge_partition(_graph(spark, d, "ps"), 4)


def locate_vertex(spark: SparkSession, d: str) -> DataFrame:
    return layout.locate(_graph(spark, d, "ps"), 4)


def _graph(spark: SparkSession, d: str, name: str) -> G.Graph:
    """A projection whose edges are written once, for plans that read them more than once."""
    return G.Graph(Workspace(spark, name).put("edges", projection(spark, d, name).edges))


def _quality(graph: G.Graph, state: DataFrame) -> DataFrame:
    """(inside, squares, mass, q) of a state, as one row."""
    inside, square, m = (F.col(c).cast("double") for c in ("inside", "squares", "mass"))
    parts = communities.modularity_parts(graph.edges, state)
    return parts.select(F.col("inside").cast("long"), F.col("squares").cast("long"), F.col("mass").cast("long"), F.round(inside / m - square / (m * m), 9).alias("q"))


def modularity_singleton(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d, "po")
    return _quality(graph, communities.initial_state(graph))


def _regions(spark: SparkSession, d: str) -> tuple[G.Graph, DataFrame]:
    """The nations' graph, with the smallest nation of each region as its community."""
    graph = _graph(spark, d, "nt")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("v"), "n_regionkey")
    first = nation.groupBy("n_regionkey").agg(F.min("v").alias("com"))
    return graph, communities.with_labels(graph, nation.join(first, "n_regionkey").select("v", "com"))


def modularity_labels(spark: SparkSession, d: str) -> DataFrame:
    return _quality(*_regions(spark, d))


def neighbor_community_weight(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _regions(spark, d)
    return communities.neighbor_weights(graph.edges, state).select("v", "dc", "e")


def internal_weight(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _regions(spark, d)
    return communities.internal_weight(communities.neighbor_weights(graph.edges, state))


def move_candidates(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _regions(spark, d)
    return communities.candidates(communities.neighbor_weights(graph.edges, state), communities.community_weight(state), G.mass(graph.edges))


def _best_move(rule: str, up: bool) -> Query:
    """Moves of the nations from their regions' communities."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return communities.best_move(*_regions(spark, d), rule, up).select("v", "com")

    return query


def _best_move_start(rule: str, up: bool) -> Query:
    """Moves of parts and orders from communities of their own."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        graph = _graph(spark, d, "po")
        return communities.best_move(graph, communities.initial_state(graph), rule, up).select("v", "com")

    return query


def _swept(spark: SparkSession, d: str, name: str) -> tuple[G.Graph, DataFrame]:
    """A graph and its state after one sweep up by rule local, both written once."""
    graph = _graph(spark, d, name)
    return graph, Workspace(spark, "swept").put("state", communities.best_move(graph, communities.initial_state(graph), "local", True))


def community_weight_direct(spark: SparkSession, d: str) -> DataFrame:
    return communities.community_weight(_swept(spark, d, "po")[1])


def community_weight_delta(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _swept(spark, d, "po")
    start = communities.initial_state(graph)
    return communities.community_weight_delta(communities.community_weight(start), start, state)


def renumber_communities(spark: SparkSession, d: str) -> DataFrame:
    return coarsening.renumber(_swept(spark, d, "po")[1])


def community_size(spark: SparkSession, d: str) -> DataFrame:
    return coarsening.community_size(_swept(spark, d, "po")[1])


def community_degree_bound(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _swept(spark, d, "po")
    return coarsening.community_degree_bound(graph.edges, state)


def community_degree_exact(spark: SparkSession, d: str) -> DataFrame:
    graph, state = _swept(spark, d, "po")
    return coarsening.community_degree_exact(graph.edges, state)


def reorder_vertices(spark: SparkSession, d: str) -> DataFrame:
    return coarsening.reorder(_swept(spark, d, "po")[1])


def even_partition(spark: SparkSession, d: str) -> DataFrame:
    return layout.even_partition(_swept(spark, d, "po")[1], "com", 4)


def coarse_edges(spark: SparkSession, d: str) -> DataFrame:
    return coarsening.coarsen(*_swept(spark, d, "po"))[0].edges


def coarse_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Mass and modularity before and after contraction."""
    graph, state = _swept(spark, d, "po")
    coarse, _ = coarsening.coarsen(graph, state)
    before, after = _quality(graph, state), _quality(coarse, communities.initial_state(coarse))
    return before.select(F.lit("fine").alias("graph"), "*").union(after.select(F.lit("coarse"), "*"))


def _groups(spark: SparkSession, d: str) -> Cliques | None:
    """The users' graph as memberships, where they are few enough."""
    return cliques(Workspace(spark, "sweeps").put("slots", user_slots(spark, d).where("user_id IS NOT NULL AND slot IS NOT NULL")))


def sweep_trace_k3(spark: SparkSession, d: str) -> DataFrame:
    """The users' graph through three sweeps in alternating direction: (loop, inside, squares, mass, q)."""
    work = Workspace(spark, "sweeps")
    groups = _groups(spark, d)
    if groups is not None:
        return _trace_of(groups, 3)
    graph = _graph(spark, d, "uc")
    state, rows = communities.initial_state(graph), []
    for i in range(3):
        state = work.put(f"state{i}", communities.best_move(graph, state, "local", i % 2 == 0))
        rows.append(_quality(graph, state).select(F.lit(i + 1).alias("loop"), "*"))
    return rows[0].union(rows[1]).union(rows[2])


def _trace_of(groups: Cliques, sweeps: int) -> DataFrame:
    """The same from memberships: what a pass finds is its state's quality, so there is one pass more than there are sweeps."""
    com, rows = np.arange(len(groups.ids)), []
    for i in range(sweeps + 1):
        com, inside, squares = groups.swept(com, "local", i % 2 == 0)
        rows.append((i, inside, squares, groups.total, inside / groups.total - squares / (float(groups.total) * float(groups.total))))
    return groups.spark.createDataFrame(rows[1:], "loop int, inside long, squares long, mass long, q double").withColumn("q", F.round("q", 9))


def _run(name: str, rule: str, max_phases: int = 1000) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return louvain(projection(spark, d, name), rule, max_phases=max_phases).membership

    return query


def _run_of_users(rule: str) -> Query:
    """A run on the users' graph, from memberships where they and the communities of its first phase are few enough."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        groups = _groups(spark, d)
        found = None if groups is None else groups.run(rule)
        if found is None:
            return _run("uc", rule)(spark, d)
        return spark.createDataFrame(pa.table({"v": groups.ids.astype(np.int64), "community": found.astype(np.int64)}))

    return query


def _levels(name: str, rule: str, **options) -> Query:
    """The phases of a run: vertices, edges, sweeps and modularity, which is rounded."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return louvain(projection(spark, d, name), rule, **options).levels_frame().withColumn("q", F.round("q", 9))

    return query


def louvain_trace_ps(spark: SparkSession, d: str) -> DataFrame:
    """The sweeps of a run with weights by their changes: modularity and its gain, both rounded."""
    rows = louvain(projection(spark, d, "ps"), weight_update="delta").trace_frame()
    return rows.select("phase", "loop", F.round("q", 9).alias("q"), F.round("dq", 9).alias("dq"))


def louvain_two_triangles(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b, 1) for a, b in TRIANGLES], "a long, b long, w long")
    return louvain(G.from_edges(pairs)).membership


def _written(spark: SparkSession, content: str) -> tuple[Workspace, str]:
    work = Workspace(spark, "mtx")
    spark.createDataFrame([(line,) for line in content.splitlines()], "value string").coalesce(1).write.text(work.at("file"))
    return work, work.at("file")


def mtx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a general file written and read again."""
    work, path = _written(spark, GENERAL)
    write_mtx(read_mtx(spark, path).edges, work.at("again"), 4)
    return read_mtx(spark, work.at("again")).edges


def mtx_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a symmetric file: as loaders weigh them, and with the file's own weights."""
    _, path = _written(spark, SYMMETRIC)
    plain, own = read_mtx(spark, path).edges, read_mtx(spark, path, symmetric_weights=None).edges
    return plain.select("src", "dst", "w", F.lit(False).alias("own")).union(own.select("src", "dst", "w", F.lit(True)))


def mtx_complex(spark: SparkSession, d: str) -> DataFrame:
    """Complex entries as they stand, written and read again."""
    work, path = _written(spark, COMPLEX)
    write_entries(read_entries(spark, path), work.at("again"), 2, 3, "complex")
    return read_entries(spark, work.at("again"))


def bin_order_move(spark: SparkSession, d: str) -> DataFrame:
    return layout.bin_order(G.degrees(projection(spark, d, "po")), "move")


def mtx_export_ps(spark: SparkSession, d: str) -> DataFrame:
    """The part-supplier graph, ids made dense, written as a general file and read again."""
    work = Workspace(spark, "mtx")
    graph = _graph(spark, d, "ps")
    ids = work.put("ids", dense_ids(graph.vertices, "v"))
    labels = ids.select("v", F.col("dense").alias("label"))
    write_mtx(coarsening.contract(graph.edges, labels), work.at("out"), ids.count())
    back = read_mtx(spark, work.at("out")).edges
    return back.select("src", "dst", F.col("w").cast("long").alias("w"))


def random_graph_40(spark: SparkSession, d: str) -> DataFrame:
    return random_graph(spark, seed=7).edges


def queries() -> dict[str, Query]:
    plain = (
        edges_symmetric, edges_lower_triangle, graph_summary, total_mass, vertex_weight, csr_offsets, degree_bins_move, degree_bins_symbolic, degree_bins_numeric,
        edge_partition_4, locate_vertex, modularity_singleton, modularity_labels, neighbor_community_weight, internal_weight, move_candidates,
        community_weight_direct, community_weight_delta, renumber_communities, community_size, community_degree_bound, community_degree_exact,
        reorder_vertices, even_partition, coarse_edges, coarse_invariants, sweep_trace_k3, louvain_trace_ps, louvain_two_triangles, mtx_roundtrip, mtx_symmetric, mtx_complex, mtx_export_ps, bin_order_move,
    )
    out = {f.__name__: f for f in plain}
    for rule in communities.RULES:
        for way in ("up", "down"):
            out[f"best_move_{rule}_{way}"] = _best_move(rule, way == "up")
            out[f"best_move_start_{rule}_{way}"] = _best_move_start(rule, way == "up")
    for rule in communities.RULES:
        for name in ("nt", "ps", "po", "uc", "ek"):
            out[f"louvain_{rule}_{name}"] = _run(name, rule) if name != "uc" else _run_of_users(rule)
        # the largest graph's first phase alone
        out[f"louvain_{rule}_po_phase0"] = _run("po", rule, 1)
        out[f"louvain_{rule}_ps_two_sweeps"] = _levels("ps", rule, max_iter=2, max_phases=2)
        out[f"louvain_levels_ps_{rule}"] = _levels("ps", rule)
    return out | {"random_graph": random_graph_40}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
