"""Golden runs on tiny graphs, properties of the steps, and layout."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork import sql
from meshwork.operators import coarsening, communities, layout
from meshwork.operators import graph as G
from meshwork.operators.ranks import prefix_sum
from meshwork.plans.louvain import louvain
from meshwork.sources import projections
from meshwork.sources.projections import projection
from meshwork.workspace import Workspace

SMALL = "/root/testdata/sf0.001"
CLIQUES = [(5 * b + i, 5 * b + j) for b in range(4) for i in range(5) for j in range(i + 1, 5)] + [(5 * b, (5 * b + 6) % 20) for b in range(4)]
TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
PATH = [(i, i + 1) for i in range(7)]
GOLDEN = [
    ([(0, 1)], "local", [(2, 2, 0.0)], [0, 0]),
    (TRIANGLES, "local", [(6, 3, 0.357143), (2, 1, 0.357143)], [0, 0, 0, 1, 1, 1]),
    (PATH, "local", [(8, 3, 0.214286), (5, 3, 0.357143), (2, 1, 0.357143)], [0, 0, 0, 0, 1, 1, 1, 1]),
    (PATH, "global", [(8, 4, 0.193878), (5, 3, 0.275510), (4, 2, 0.316327), (3, 1, 0.316327)], [0, 0, 0, 0, 1, 2, 2, 2]),
    (CLIQUES, "local", [(20, 3, 0.659091), (4, 1, 0.659091)], [i // 5 for i in range(20)]),
    (CLIQUES, "global", [(20, 3, 0.590134), (5, 2, 0.659091), (4, 1, 0.659091)], [i // 5 for i in range(20)]),
]


def graph(spark, rows, vertices=None, kind="long"):
    more = None if vertices is None else spark.createDataFrame([(v,) for v in vertices], "v long")
    return G.from_edges(spark.createDataFrame(rows, f"a long, b long, w {kind}"), vertices=more)


def levels(result):
    return [(n, loops, round(q, 6)) for _, n, _, loops, q in result.levels]


@pytest.mark.parametrize("edges,rule,expected,members", GOLDEN)
def test_golden(spark, edges, rule, expected, members):
    result = louvain(graph(spark, [(a, b, 1) for a, b in edges]), rule)
    assert levels(result) == expected
    assert [r.community for r in result.membership.orderBy("v").collect()] == members
    assert result.phases == len(expected) - 1
    assert [t[1] for t in result.trace if t[0] == 0] == list(range(1, expected[0][1] + 1))


#: n/sweeps/Q of the phases of runs on the projections, by tables, graph and rule.
RUNS = {
    ("0.001", "nt", "local"): "25/2/-0.008216",
    ("0.001", "nt", "global"): "25/1/-0.038093",
    ("0.001", "ps", "local"): "210/5/0.112927 10/2/0.114955 9/1/0.114955",
    ("0.001", "ps", "global"): "210/7/0.110007 10/1/0.110007",
    ("0.001", "po", "local"): "1673/4/0.376363 200/10/0.435178 49/4/0.441268 23/1/0.441268",
    ("0.001", "po", "global"): "1673/4/0.376363 200/4/0.381756 95/3/0.382844 48/1/0.382844",
    ("0.001", "uc", "local"): "15/3/0.112310 6/1/0.112310",
    ("0.001", "uc", "global"): "15/4/0.015506 7/2/0.017108 5/2/0.057640 4/2/0.078188 2/1/0.078188",
    ("0.001", "ek", "local"): "500/8/0.222368 185/8/0.372965 50/12/0.410794 16/2/0.411717 14/1/0.411717",
    ("0.001", "ek", "global"): "500/4/0.139026 207/3/0.173830 111/3/0.186194 57/1/0.186194",
    ("0.01", "ps", "local"): "2100/7/0.087187 99/10/0.097307 26/5/0.098665 14/2/0.098673 13/1/0.098673",
    ("0.01", "ps", "global"): "2100/4/0.083942 102/1/0.083942",
    ("0.01", "po", "local"): "16743/6/0.375258 1995/36/0.438490 273/7/0.446896 80/1/0.446896",
    ("0.01", "po", "global"): "16743/6/0.375258 1995/7/0.380833 814/2/0.381067 478/1/0.381067",
    ("0.01", "uc", "local"): "150/21/0.059863 13/3/0.063533 7/1/0.063533",
    ("0.01", "uc", "global"): "150/25/0.057801 13/1/0.057801",
    ("0.01", "ek", "local"): "500/9/0.235390 184/13/0.382543 49/7/0.412491 17/2/0.416359 13/1/0.416359",
    ("0.01", "ek", "global"): "500/4/0.158235 197/3/0.207925 100/3/0.224847 54/1/0.224847",
}


@pytest.mark.parametrize("sf,name,rule", RUNS)
def test_sql_of_whole_runs(sf, name, rule):
    """The SQL that registered runs are compared with gives the known phases."""
    duck = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "events", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    rows = duck.sql(sql.with_(name, sql.run(name, rule), select=sql.LEVELS)).order("phase").fetchall()
    assert " ".join(f"{n}/{loops}/{q:.6f}" for _, n, _, loops, q in rows) == RUNS[sf, name, rule]


def test_run_of_the_largest_graph(spark):
    result = louvain(projection(spark, SMALL, "po"))
    assert " ".join(f"{n}/{loops}/{q:.6f}" for n, loops, q in levels(result)) == RUNS["0.001", "po", "local"]
    assert len(result.times) == 4 and set(result.totals) == {"clustering", "coarsening", "total"} and result.times_frame().count() == 4


def test_hubs_change_nothing(spark, monkeypatch):
    """With rows at hubs apart, every run is the same."""
    rng = random.Random(5)
    rows = [(0, i, rng.randint(1, 4)) for i in range(1, 30)] + [(rng.randrange(30), rng.randrange(30), 1) for _ in range(60)] + [(0, 0, 3)]
    plain = [louvain(graph(spark, rows, vertices=[77]), rule, max_phases=1) for rule in communities.RULES]
    monkeypatch.setattr(G, "HUB_ROWS", 8)
    for a, rule in zip(plain, communities.RULES, strict=True):
        b = louvain(graph(spark, rows, vertices=[77]), rule, max_phases=1)
        assert a.levels == b.levels and sorted(a.membership.collect()) == sorted(b.membership.collect())
    work = Workspace(spark, "hubs")
    apart = G.dealt(work.put("edges", graph(spark, rows).edges), work, "d")
    assert apart.hubs.count() >= 1 and not apart.to_hub.isEmpty() and not apart.from_hub.isEmpty()


def test_tables_of_a_run_are_dropped(spark, tmp_path, monkeypatch):
    """Of a finished run only the membership is left."""
    monkeypatch.setattr("meshwork.workspace.shared_dir", lambda _: f"file://{tmp_path}")
    result = louvain(graph(spark, [(a, b, 1) for a, b in CLIQUES], vertices=[99]))
    left = {p.name for run in tmp_path.glob("louvain-*") for p in run.iterdir()}
    assert result.membership.count() == 21 and len(left) <= 4 and not any(n.startswith(("sweep", "dealt", "state", "weights")) for n in left)


def test_delta_equals_direct_and_doubles_equal_longs(spark):
    rows = [(a, b, 1) for a, b in CLIQUES]
    runs = [louvain(graph(spark, rows), weight_update="delta"), louvain(graph(spark, rows)), louvain(graph(spark, [(a, b, 1.0) for a, b, _ in rows], kind="double"))]
    assert len({tuple(levels(r)) for r in runs}) == 1
    assert len({tuple(x.community for x in r.membership.orderBy("v").collect()) for r in runs}) == 1


def test_limits_and_errors(spark):
    g = graph(spark, [(a, b, 1) for a, b in PATH])
    assert len(louvain(g, max_iter=1, max_phases=1).trace) == 1
    assert louvain(g, max_phases=0).membership.where("v <> community").isEmpty()
    with pytest.raises(ValueError):
        louvain(g, rule="other")
    with pytest.raises(ValueError):
        louvain(g, weight_update="other")


def test_empty_and_isolated(spark):
    assert louvain(graph(spark, [])).membership.isEmpty()
    result = louvain(graph(spark, [(0, 1, 1)], vertices=[7]))
    assert {(r.v, r.community) for r in result.membership.collect()} == {(0, 0), (1, 0), (7, 1)}
    assert [r.k for r in G.vertex_weight(graph(spark, [(0, 1, 1)], vertices=[7])).orderBy("v").collect()] == [1, 1, 0]


def brute_modularity(edges, com):
    m = sum(w for _, _, w in edges)
    a = {}
    for s, _, w in edges:
        a[com[s]] = a.get(com[s], 0) + w
    return sum(w for s, d, w in edges if com[s] == com[d]) / m - sum(x * x for x in a.values()) / m**2


@pytest.mark.parametrize("seed", range(4))
def test_steps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 14)
    pairs = {}
    for _ in range(rng.randint(n, 3 * n)):
        a, b = sorted((rng.randrange(n), rng.randrange(n)))
        pairs[a, b] = pairs.get((a, b), 0) + rng.randint(1, 9)
    g = graph(spark, [(a, b, w) for (a, b), w in pairs.items()], vertices=range(n))
    edges = [tuple(r) for r in g.edges.collect()]
    labels = {v: rng.randrange(4) for v in range(n)}
    first = {c: min(v for v in labels if labels[v] == c) for c in labels.values()}
    com = {v: first[c] for v, c in labels.items()}
    state = communities.with_labels(g, spark.createDataFrame(list(com.items()), "v long, com long"))
    total = G.mass(g.edges)
    q = brute_modularity(edges, com)
    assert abs(communities.modularity(g, state) - q) < 1e-12
    near = communities.neighbor_weights(g.edges, state)
    weights = communities.community_weight(state)
    assert {(r.v, r.com): r.e_own for r in communities.internal_weight(near).collect()} == {(v, com[v]): sum(w for s, d, w in edges if s == v != d and com[d] == com[v]) for v in {s for s, _, _ in edges}}
    gains = {(r.v, r.candidate): r.score for r in communities.candidates(near, weights, total).collect()}
    for (v, c), score in gains.items():
        assert abs(score * 2 / total**2 - (brute_modularity(edges, com | {v: c}) - q)) < 1e-12
    for rule in communities.RULES:
        for up in (True, False):
            moved = {r.v: r.com for r in communities.best_move(g, state, rule, up).collect()}
            wide = {r.v: r.com for r in communities.best_move(g, state, rule, up, wide=True).collect()} if rule == "local" and up else moved
            better = (lambda c, s: c < s) if up else (lambda c, s: c > s)
            for v in range(n):
                options = [(0, com[v])] + [(s, c) for (x, c), s in gains.items() if x == v and (rule == "local" or better(c, com[v]))]
                best = min(options, key=lambda o: (-o[0], o[1] if up else -o[1]))[1]
                expected = best if better(best, com[v]) else com[v]
                assert moved[v] == wide[v] == expected
    coarse, _ = coarsening.coarsen(g, state)
    assert G.mass(coarse.edges) == total
    assert abs(communities.modularity(coarse, communities.initial_state(coarse)) - q) < 1e-12


def test_layout(spark):
    g = graph(spark, [(0, i, 1) for i in range(1, 9)] + [(1, 2, 1)])
    offsets = {r.v: (r.degree, r.row_offset) for r in G.csr_offsets(g).collect()}
    assert offsets[0] == (8, 0) and offsets[1] == (2, 8) and offsets[8] == (1, 17)
    parts = {r.part: (r.first_edge, r.first_vertex) for r in layout.edge_partition(g, 4).collect()}
    assert parts == {0: (0, 0), 1: (5, 0), 2: (10, 2), 3: (14, 5)}
    owners = {r.v: (r.part, r.local_id) for r in layout.locate(g, 4).collect()}
    assert owners[0] == (1, 0) and owners[2] == (2, 0) and owners[8] == (3, 3)
    assert {r.bin: r.vertices for r in layout.degree_bins(G.degrees(g), "move").collect()} == {0: 8, 2: 1}
    even = layout.even_partition(g.vertices, "v", 4)
    assert [r.part for r in even.orderBy("v").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert [r.part for r in layout.even_partition(g.vertices.where("v < 2"), "v", 4).orderBy("v").collect()] == [0, 1]


def test_prefix_sum_in_ranges(spark, monkeypatch):
    from meshwork.operators import ranks

    monkeypatch.setattr(ranks, "ONE_WINDOW", 10)
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("k"), F.lit(2).cast("long").alias("n"))
    assert prefix_sum(df, ["k"], "n", "s").where("s <> 2 * (k + 1)").isEmpty()


def test_bin_order(spark):
    g = graph(spark, [(0, i, 1) for i in range(1, 9)] + [(1, 2, 1)], vertices=[20])
    rows = layout.bin_order(G.degrees(g), "move").orderBy("position").collect()
    assert [(r.v, r.bin) for r in rows] == [(v, 0) for v in range(1, 9)] + [(20, 0), (0, 2)]


def test_nearest_vectors_against_brute_force(spark, tmp_path, monkeypatch):
    """Clustered vectors, ties, copies, a vector of zeros, and blocks smaller than cells."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(9)] + [(300, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in unit.items()}
    want = set()
    for i, v in unit.items():
        best = sorted((-round(float(v @ u), 9), j) for j, u in unit.items() if j != i)[:5]
        want |= {(min(i, j), max(i, j)) for _, j in best}
    for block in (512, 7):
        monkeypatch.setattr(projections, "BLOCK", block)
        assert {(r.a, r.b) for r in projections.embedding_neighbors(spark, str(tmp_path)).collect()} == want


def test_busy_slots(spark, monkeypatch):
    """Slots in parts give the same pairs."""
    want = sorted(projections.user_cooccurrence(spark, SMALL).collect())
    monkeypatch.setattr(projections, "BLOCK", 2)
    assert sorted(projections.user_cooccurrence(spark, SMALL).collect()) == want


def test_nearest_vectors_in_slabs(spark, tmp_path, monkeypatch):
    """Vectors without clusters, and copies: slabs and crowds change nothing, and no table has a row for each vector and cell."""
    rng = np.random.default_rng(9)
    rows = [(3 * i, rng.normal(size=16).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids, unit = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    want = {(min(i, j), max(i, j)) for at, i in enumerate(ids) for j in sorted((j for j in ids if j != i), key=lambda j: (-score[at, ids.searchsorted(j)], j))[:5]}
    for most in (1 << 24, 1500):
        monkeypatch.setattr("meshwork.workspace.shared_dir", lambda _, most=most: f"file://{tmp_path}/{most}")
        monkeypatch.setattr(projections, "MOST_NUMBERS", most, raising=False)
        monkeypatch.setattr(projections, "MOST_SCORED", 30 if most == 1500 else 512, raising=False)
        assert {(r.a, r.b) for r in projections.embedding_neighbors(spark, str(tmp_path)).collect()} == want
        assert all(spark.read.parquet(str(p)).count() <= 5 * len(rows) for p in (tmp_path / str(most)).glob("*/*.parquet"))
