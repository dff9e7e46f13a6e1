"""Phases on blocks of rows give what runs in one task give (those are held against tables in test_packed), and write no tables of sweeps."""

import random

import pytest

from meshwork.operators import communities
from meshwork.operators import graph as G
from meshwork.plans import packed, spread
from meshwork.plans.louvain import louvain
from meshwork.workspace import Workspace


def told(result):
    return result.levels, [t[:4] for t in result.trace], len(result.times), result.q, result.phases, sorted(map(tuple, result.membership.collect()))


def graph(spark, seed):
    """Groups of vertices with most rows inside, self-loops and ids of any size."""
    rng = random.Random(seed)
    ids = [rng.randrange(-(10**12), 10**12) for _ in range(60)]
    rows = [(ids[v := rng.randrange(60)], ids[v // 6 * 6 + rng.randrange(6) if rng.random() < 0.8 else rng.randrange(60)], rng.randint(1, 9)) for _ in range(400)]
    return G.from_edges(spark.createDataFrame(rows, "a long, b long, w long"))


@pytest.mark.parametrize("case", (0, 1))
def test_run_on_blocks(spark, monkeypatch, case):
    """Both rules, few sweeps and phases, and an end in one task."""
    g, rule = graph(spark, case), communities.RULES[case]
    options = {"max_iter": 2, "max_phases": 2} if case else {}
    in_a_task = told(louvain(g, rule, **options))
    assert len(in_a_task[0]) > 1
    written, put = [], Workspace.put
    monkeypatch.setattr(Workspace, "put", lambda self, name, df, *by: (written.append(name), put(self, name, df, *by))[1])
    monkeypatch.setattr(spread, "BLOCK_ROWS", 16)
    monkeypatch.setattr(packed, "MOST_ROWS", -1 if case else in_a_task[0][0][2] - 1)  # the first phase is one row too large, or all are
    assert told(louvain(g, rule, **options)) == in_a_task
    assert "blocks0" in written and not [n for n in written if n.startswith(("sweep", "state"))]
    assert ("blocks1" if case else "rest1") in written


def test_what_does_not_fit(spark):
    """Ends that are no source, vertices with too many rows, weights below 0 and products beyond 64 bits."""
    work = Workspace(spark, "spread")
    rows = [((1, 2, 1), (2, 1, 1), (2, 3, 1)), ((1, 2, -1), (2, 1, -1), (1, 1, 9)), ((1, 2, 10**10), (2, 1, 10**10)), ((1, 2, 1), (2, 1, 1), (2, 2, None))]
    for i, r in enumerate(rows):
        edges = work.put(f"edges{i}", spark.createDataFrame(r, "src long, dst long, w long"))
        assert spread.spread(edges, G.mass(edges), work, f"blocks{i}") is None
