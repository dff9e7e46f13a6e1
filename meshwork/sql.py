"""DuckDB SQL that says the same as the registered queries. Moves are ranked by row_number here, not by an aggregate."""

from __future__ import annotations

from meshwork.functions.scores import BINS

PAIRS = {
    "po": "SELECT l_partkey AS a, 1000000000 + l_orderkey AS b, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2",
    "ps": "SELECT l_partkey AS a, 1000000000 + l_suppkey AS b, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2",
    "nt": """SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS a, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS b, count(*) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "uc": """SELECT x.user_id AS a, y.user_id AS b, count(*) AS w
      FROM (SELECT DISTINCT user_id, epoch_us(ts) // 600000000 AS slot FROM events) x
      JOIN (SELECT DISTINCT user_id, epoch_us(ts) // 600000000 AS slot FROM events) y ON x.slot = y.slot AND x.user_id < y.user_id GROUP BY 1, 2""",
    "ek": """SELECT DISTINCT CAST(least(a, b) AS BIGINT) AS a, CAST(greatest(a, b) AS BIGINT) AS b, CAST(1 AS BIGINT) AS w FROM (
      SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM (
        SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)) WHERE r <= 5""",
    "triangles": "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(1 AS BIGINT) AS w FROM (VALUES (0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)) t(a, b)",
}


def graph(name: str) -> str:
    """CTEs: pairs, edges (src, dst, w), vertices (v), weights of vertices (v, k), mass (m)."""
    return f"""pairs AS MATERIALIZED ({PAIRS[name]}),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs WHERE a <> b),
vertices AS MATERIALIZED (SELECT DISTINCT src AS v FROM edges),
kv AS MATERIALIZED (SELECT src AS v, CAST(sum(w) AS BIGINT) AS k FROM edges GROUP BY 1),
total AS MATERIALIZED (SELECT CAST(sum(w) AS BIGINT) AS m FROM edges)"""


START = "s0 AS MATERIALIZED (SELECT v, k, v AS com FROM kv)"
REGIONS = """s0 AS MATERIALIZED (
  SELECT v, k, com FROM kv JOIN (SELECT CAST(n_nationkey AS BIGINT) AS v, CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS com FROM nation) USING (v))"""


def near(state: str, edges: str = "edges", out: str = "near") -> str:
    return f"""{out} AS MATERIALIZED (
  SELECT x.v, x.k, x.com, y.com AS dc, CAST(sum(w) AS BIGINT) AS e, CAST(sum(CASE WHEN src = dst THEN w ELSE 0 END) AS BIGINT) AS loop
  FROM {edges} JOIN {state} x ON src = x.v JOIN {state} y ON dst = y.v GROUP BY 1, 2, 3, 4)"""


def sweep(i: int, rule: str, up: bool, edges: str = "edges", p: str = "s") -> str:
    """CTEs from state p<i> to the moved state p<i>m, with candidates ranked by row_number."""
    better, pick = ("<", "least") if up else (">", "greatest")
    only = f"AND dc {better} n.com" if rule == "global" else ""
    gate = f"{pick}(c, com)" if rule == "local" else "c"
    order = "c" if up else "c DESC"
    return f"""{near(f"{p}{i}", edges, f"{p}{i}near")},
{p}{i}w AS MATERIALIZED (SELECT com, CAST(sum(k) AS BIGINT) AS a FROM {p}{i} GROUP BY 1),
{p}{i}own AS MATERIALIZED (SELECT v, sum(CASE WHEN dc = com THEN e - loop ELSE 0 END) AS e_own FROM {p}{i}near GROUP BY 1),
{p}{i}cand AS MATERIALIZED (
  SELECT n.v, n.com, n.k, dc AS c, (SELECT m FROM total) * (CAST(e AS HUGEINT) - e_own) + n.k * (CAST(o.a AS HUGEINT) - n.k - t.a) AS score
  FROM {p}{i}near n JOIN {p}{i}own USING (v) JOIN {p}{i}w o ON o.com = n.com JOIN {p}{i}w t ON t.com = n.dc WHERE n.dc <> n.com {only}
  UNION ALL SELECT v, com, k, com, 0 FROM {p}{i}
),
{p}{i}m AS MATERIALIZED (
  SELECT v, k, {gate} AS com FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, {order}) AS r FROM {p}{i}cand) WHERE r = 1
)"""


def parts(state: str, edges: str = "edges") -> str:
    """SELECT of inside, squares, mass, q of a state."""
    return f"""SELECT inside, squares, m AS mass, round(inside / m - squares / (CAST(m AS DOUBLE) * m), 9) AS q FROM (
  SELECT (SELECT CAST(coalesce(sum(w), 0) AS BIGINT) FROM {edges} JOIN {state} x ON src = x.v JOIN {state} y ON dst = y.v WHERE x.com = y.com) AS inside,
    (SELECT CAST(sum(CAST(a AS HUGEINT) * a) AS BIGINT) FROM (SELECT sum(k) AS a FROM {state} GROUP BY com)) AS squares, m FROM total)"""


def bin_of(kind: str, degree: str) -> str:
    case = " ".join(f"WHEN {degree} <= {end} THEN {i}" for i, end in enumerate(BINS[kind]))
    return f"CAST(CASE {case} ELSE {len(BINS[kind])} END AS INTEGER)"


def bins(kind: str, source: str) -> str:
    return f"SELECT {bin_of(kind, 'degree')} AS bin, count(*) AS vertices, max(degree) AS max_degree FROM ({source}) GROUP BY 1"


OFFSETS = "offsets AS MATERIALIZED (SELECT src AS v, count(*) AS degree, CAST(sum(count(*)) OVER (ORDER BY src) AS BIGINT) - count(*) AS row_offset FROM edges GROUP BY src)"
STARTS = """bounds AS (SELECT p, p * (e // 4) + least(p, e % 4) AS first_edge FROM (SELECT count(*) AS e FROM edges), (SELECT unnest(range(4)) AS p)),
starts AS MATERIALIZED (SELECT CAST(p AS INTEGER) AS part, first_edge, v AS first_vertex FROM bounds JOIN offsets ON row_offset <= first_edge AND first_edge < row_offset + degree)"""


def run(name: str, rule: str = "local", max_iter: int = 1 << 30, max_phases: int = 1 << 30) -> str:
    """CTEs of a whole run. walk has a row for each state of the run and each vertex: pos, the vertex's place in the phase's graph, and com.

    Every step groups the first graph's edges by the phase's places, so contraction is implied. "over" is set by the last row
    of a phase, whose com is the phase's result; "done" by the last phase.
    """

    def side(up: str, down: str) -> str:
        return f"CASE WHEN (SELECT any_value(loop) FROM now) % 2 = 0 THEN {up} ELSE {down} END"

    only = f"AND {side('dc < com', 'dc > com')}" if rule == "global" else ""
    gate = side("least(c, com)", "greatest(c, com)")
    return f"""walk AS (
  SELECT v, v AS pos, v AS com, 0 AS phase, 0 AS loop, CAST(NULL AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS q_old, false AS over, false AS done, CAST(NULL AS DOUBLE) AS tried, CAST(NULL AS DOUBLE) AS gain FROM kv
  UNION ALL
  (WITH now AS (SELECT * FROM walk WHERE NOT done),
  spot AS (SELECT pos, any_value(com) AS com, CAST(sum(k) AS BIGINT) AS k FROM now JOIN kv USING (v) GROUP BY pos),
  heavy AS (SELECT com, CAST(sum(k) AS BIGINT) AS a FROM spot GROUP BY 1),
  near AS (
    SELECT x.pos, y.com AS dc, CAST(sum(w) AS BIGINT) AS e, CAST(sum(CASE WHEN x.pos = y.pos THEN w ELSE 0 END) AS BIGINT) AS loop
    FROM edges JOIN now x ON src = x.v JOIN now y ON dst = y.v GROUP BY 1, 2
  ),
  q_now AS (
    SELECT (SELECT coalesce(sum(e), 0) FROM near JOIN spot USING (pos) WHERE dc = com) / m - (SELECT sum(CAST(a AS HUGEINT) * a) FROM heavy) / (CAST(m AS DOUBLE) * m) AS q FROM total
  ),
  own AS (SELECT pos, sum(CASE WHEN dc = com THEN e - loop ELSE 0 END) AS e_own FROM near JOIN spot USING (pos) GROUP BY 1),
  options AS (
    SELECT pos, com, dc AS c, (SELECT m FROM total) * (CAST(e AS HUGEINT) - e_own) + k * (CAST(o.a AS HUGEINT) - k - t.a) AS score
    FROM near JOIN spot USING (pos) JOIN own USING (pos) JOIN heavy o USING (com) JOIN heavy t ON t.com = dc WHERE dc <> com {only}
    UNION ALL SELECT pos, com, com, 0 FROM spot
  ),
  chosen AS (
    SELECT pos, {gate} AS com FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, {side('c', '-c')}) AS r FROM options) WHERE r = 1
  ),
  moved AS (SELECT x.v, y.pos, y.com FROM now x JOIN chosen y USING (pos)),
  q_moved AS (
    SELECT (SELECT coalesce(sum(w), 0) FROM edges JOIN moved x ON src = x.v JOIN moved y ON dst = y.v WHERE x.com = y.com) / m
      - (SELECT sum(CAST(a AS HUGEINT) * a) FROM (SELECT sum(k) AS a FROM moved JOIN kv USING (v) GROUP BY com)) / (CAST(m AS DOUBLE) * m) AS q FROM total
  ),
  facts AS (
    SELECT q_now.q, q_moved.q AS found, NOT (SELECT any_value(over) FROM now) AND (SELECT any_value(loop) FROM now) < {max_iter} AS may, q_moved.q - q_now.q > 1e-6 AS better FROM q_now, q_moved
  ),
  labels AS (SELECT v, dense_rank() OVER (ORDER BY com) - 1 AS label FROM now)
  -- an accepted sweep
  SELECT v, moved.pos, moved.com, phase, now.loop + 1, found, q_old, false, false, found, found - facts.q FROM moved JOIN now USING (v), facts WHERE may AND better
  UNION ALL
  -- the end of a phase; a rejected sweep counts
  SELECT v, pos, com, phase, now.loop + CAST(may AS INTEGER), facts.q, q_old, true, facts.q - q_old <= 1e-6, CASE WHEN may THEN found END, found - facts.q FROM now, facts WHERE NOT over AND NOT (may AND better)
  UNION ALL
  -- the next phase
  SELECT v, label, label, phase + 1, 0, facts.q, facts.q, false, false, NULL, NULL FROM now JOIN labels USING (v), facts WHERE over AND phase + 1 < {max_phases})
)"""


def with_(name: str, *ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([graph(name), *ctes]) + "\n" + select


SWEPT = f"{START},\n{sweep(0, 'local', True)}"
DENSE = "dense AS MATERIALIZED (SELECT v, com, dense_rank() OVER (ORDER BY com) - 1 AS dense FROM s0m)"
COARSE = "coarse AS MATERIALIZED (SELECT x.dense AS src, y.dense AS dst, CAST(sum(w) AS BIGINT) AS w FROM edges JOIN dense x ON src = x.v JOIN dense y ON dst = y.v GROUP BY 1, 2)"
BOUND = "SELECT x.com, count(*) AS degree FROM edges JOIN s0m x ON src = x.v GROUP BY 1"
EXACT = "SELECT x.com, count(DISTINCT y.com) AS degree FROM edges JOIN s0m x ON src = x.v JOIN s0m y ON dst = y.v GROUP BY 1"

LAST = "SELECT v, dense_rank() OVER (ORDER BY com) - 1 AS community FROM walk WHERE over AND phase = (SELECT max(phase) FROM walk WHERE over)"
LEVELS = """SELECT phase, vertices, edges, loops, round(q, 9) AS q FROM
  (SELECT phase, count(DISTINCT pos) AS vertices, max(loop) AS loops, max(CASE WHEN over THEN q END) AS q FROM walk GROUP BY 1)
  JOIN (SELECT x.phase, count(DISTINCT (x.pos, y.pos)) AS edges FROM edges JOIN walk x ON src = x.v JOIN walk y ON dst = y.v AND x.phase = y.phase WHERE x.over AND y.over GROUP BY 1) USING (phase)"""


ORACLES = {
    "edges_symmetric": with_("ps", select="SELECT src, dst, w FROM edges"),
    "edges_lower_triangle": with_("nt", select="SELECT src, dst, w FROM edges WHERE dst < src"),
    "graph_summary": with_("po", select="SELECT (SELECT count(*) FROM vertices) AS vertices, count(*) AS edges, CAST(sum(w) AS BIGINT) AS mass FROM edges"),
    "total_mass": with_("po", select="SELECT m AS mass FROM total"),
    "vertex_weight": with_("po", select="SELECT v, k FROM kv"),
    "csr_offsets": with_("po", OFFSETS, select="SELECT v, degree, row_offset FROM offsets"),
    "degree_bins_move": with_("po", select=bins("move", "SELECT src, count(*) AS degree FROM edges GROUP BY 1")),
    "degree_bins_symbolic": with_("po", SWEPT, select=bins("symbolic", BOUND)),
    "degree_bins_numeric": with_("ps", SWEPT, select=bins("numeric", EXACT)),
    "edge_partition_4": with_("ps", OFFSETS, STARTS, select="SELECT part, first_edge, first_vertex FROM starts"),
    "locate_vertex": with_(
        "ps", OFFSETS, STARTS, "owned AS (SELECT v, max(part) AS part FROM vertices JOIN starts ON first_vertex <= v GROUP BY 1)",
        select="SELECT v, part, row_number() OVER (PARTITION BY part ORDER BY v) - 1 AS local_id FROM owned",
    ),
    "modularity_singleton": with_("po", START, select=parts("s0")),
    "modularity_labels": with_("nt", REGIONS, select=parts("s0")),
    "neighbor_community_weight": with_("nt", REGIONS, near("s0"), select="SELECT v, dc, e FROM near"),
    "internal_weight": with_("nt", REGIONS, near("s0"), select="SELECT v, com, CAST(sum(CASE WHEN dc = com THEN e - loop ELSE 0 END) AS BIGINT) AS e_own FROM near GROUP BY 1, 2"),
    "move_candidates": with_("nt", REGIONS, sweep(0, "local", True), select="SELECT v, com, c AS candidate, CAST(score AS BIGINT) AS score FROM s0cand WHERE c <> com"),
    "community_weight_direct": with_("po", SWEPT, select="SELECT com, CAST(sum(k) AS BIGINT) AS a FROM s0m GROUP BY 1"),
    "community_weight_delta": with_("po", SWEPT, select="SELECT s0.com, CAST(coalesce(sum(s0m.k), 0) AS BIGINT) AS a FROM s0 LEFT JOIN s0m ON s0m.com = s0.com GROUP BY 1"),
    "renumber_communities": with_("po", SWEPT, DENSE, select="SELECT v, com, dense FROM dense"),
    "community_size": with_("po", SWEPT, select="SELECT com, count(*) AS size FROM s0m GROUP BY 1"),
    "community_degree_bound": with_("po", SWEPT, select=BOUND),
    "community_degree_exact": with_("po", SWEPT, select=EXACT),
    "reorder_vertices": with_("po", SWEPT, select="SELECT v, com, row_number() OVER (ORDER BY com, v) - 1 AS position FROM s0m"),
    "even_partition": with_("po", SWEPT, select="SELECT com, CAST(ntile(4) OVER (ORDER BY com) - 1 AS INTEGER) AS part FROM (SELECT DISTINCT com FROM s0m)"),
    "coarse_edges": with_("po", SWEPT, DENSE, COARSE, select="SELECT src, dst, w FROM coarse"),
    "coarse_invariants": with_(
        "po", SWEPT, DENSE, COARSE, "c0 AS MATERIALIZED (SELECT src AS v, CAST(sum(w) AS BIGINT) AS k, src AS com FROM coarse GROUP BY 1)",
        select=f"SELECT 'fine' AS graph, * FROM ({parts('s0m')}) UNION ALL SELECT 'coarse', * FROM ({parts('c0', 'coarse')})",
    ),
    "sweep_trace_k3": with_(
        "uc", START, *(f"{sweep(i, 'local', i % 2 == 0)},\ns{i + 1} AS (SELECT * FROM s{i}m)" for i in range(3)),
        select=" UNION ALL ".join(f"SELECT {i} AS loop, * FROM ({parts(f's{i}')})" for i in (1, 2, 3)),
    ),
    "louvain_two_triangles": with_("triangles", run("triangles"), select=LAST),
    "louvain_trace_ps": with_("ps", run("ps"), select="SELECT DISTINCT phase, loop, round(tried, 9) AS q, round(gain, 9) AS dq FROM walk WHERE tried IS NOT NULL"),
    "bin_order_move": with_("po", select=f"SELECT v, bin, row_number() OVER (ORDER BY bin, v) - 1 AS position FROM (SELECT src AS v, {bin_of('move', 'count(*)')} AS bin FROM edges GROUP BY src)"),
    "mtx_symmetric": """SELECT CAST(s AS BIGINT) AS src, CAST(d AS BIGINT) AS dst, CAST(w AS DOUBLE) AS w, own FROM (VALUES
      (0, 0, 1, false), (0, 1, 1, false), (1, 0, 1, false), (1, 2, 2, false), (2, 1, 2, false), (0, 3, 1, false), (3, 0, 1, false),
      (0, 0, 5, true), (0, 1, 2, true), (1, 0, 2, true), (1, 2, 5.5, true), (2, 1, 5.5, true), (0, 3, 0.5, true), (3, 0, 0.5, true)) t(s, d, w, own)""",
    "mtx_complex": "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(w AS DOUBLE) AS w, CAST(im AS DOUBLE) AS im FROM (VALUES (0, 0, 1.5, -2), (1, 2, 0, 4.25), (0, 1, -3, 0)) t(a, b, w, im)",
    "random_graph": """WITH pairs AS (SELECT i // 40 AS s, i % 40 AS d, CAST('0x' || substr(md5('7:' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 AS x FROM range(1600) t(i)),
      kept AS (SELECT s, d, 1 + x / 1000000 AS w FROM pairs WHERE x < 100000)
      SELECT src, dst, sum(w) AS w FROM (SELECT s AS src, d AS dst, w FROM kept UNION ALL SELECT d, s, w FROM kept WHERE s <> d) GROUP BY 1, 2""",
    "mtx_roundtrip": "SELECT CAST(s AS BIGINT) AS src, CAST(d AS BIGINT) AS dst, CAST(w AS DOUBLE) AS w FROM (VALUES (0, 1, 1.5), (1, 0, 1.5), (0, 2, 2.0), (2, 0, 2.0), (2, 3, 0.5), (3, 2, 0.5)) t(s, d, w)",
    "mtx_export_ps": with_("ps", "ids AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM vertices)", select="SELECT x.i AS src, y.i AS dst, w FROM edges JOIN ids x ON src = x.v JOIN ids y ON dst = y.v"),
}
for _rule in ("local", "global"):
    for _way in ("up", "down"):
        ORACLES[f"best_move_{_rule}_{_way}"] = with_("nt", REGIONS, sweep(0, _rule, _way == "up"), select="SELECT v, com FROM s0m")
        ORACLES[f"best_move_start_{_rule}_{_way}"] = with_("po", START, sweep(0, _rule, _way == "up"), select="SELECT v, com FROM s0m")
    for _name in ("nt", "ps", "po", "uc", "ek"):
        ORACLES[f"louvain_{_rule}_{_name}"] = with_(_name, run(_name, _rule), select=LAST)
    ORACLES[f"louvain_{_rule}_po_phase0"] = with_("po", run("po", _rule, max_phases=1), select=LAST)
    ORACLES[f"louvain_{_rule}_ps_two_sweeps"] = with_("ps", run("ps", _rule, max_iter=2, max_phases=2), select=LEVELS)
    ORACLES[f"louvain_levels_ps_{_rule}"] = with_("ps", run("ps", _rule), select=LEVELS)
