"""Sweeps from memberships give what sweeps on pairs give, and write no pairs."""

import pytest

from meshwork import catalog
from meshwork.operators import cliques, communities
from meshwork.plans.louvain import louvain
from meshwork.sources.projections import projection

SMALL = "/root/testdata/sf0.001"


def test_no_pairs_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("meshwork.workspace.shared_dir", lambda _: f"file://{tmp_path}")
    rows = sorted(catalog.sweep_trace_k3(spark, SMALL).collect())
    tables = {p.name: spark.read.parquet(str(p)).count() for p in tmp_path.glob("*/*.parquet")}
    assert set(tables) == {"slots.parquet"}
    monkeypatch.setattr(cliques, "MOST_MEMBERS", 0)
    assert sorted(catalog.sweep_trace_k3(spark, SMALL).collect()) == rows


@pytest.mark.parametrize("rule", communities.RULES)
def test_runs_from_memberships(spark, tmp_path, monkeypatch, rule):
    """A whole run writes no pairs and gives what a run on pairs gives, where there are too many communities or memberships as well."""
    query = catalog.queries()[f"louvain_{rule}_uc"]
    with monkeypatch.context() as m:
        m.setattr("meshwork.workspace.shared_dir", lambda _: f"file://{tmp_path}")
        here = query(spark, SMALL)
        rows = sorted(here.collect())
    assert {p.name for p in tmp_path.glob("*/*.parquet")} == {"slots.parquet"}
    on_pairs = louvain(projection(spark, SMALL, "uc"), rule).membership
    assert here.dtypes == on_pairs.dtypes and sorted(on_pairs.collect()) == rows
    monkeypatch.setattr(cliques, "MOST_COARSE", 0)
    assert sorted(query(spark, SMALL).collect()) == rows
