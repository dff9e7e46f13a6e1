"""The pipeline against its parts in plain Python, and every query against its SQL."""

import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from meshwork.llm import queries as Q
from meshwork.llm import toxicity as T
from meshwork.llm.common import table
from tests.llm.test_dedup import brute_lines, components_of
from tests.llm.test_models import item_sets

D = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    result = corpus_pipeline.run(spark, D)
    docs = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    labels = table(spark, D, "labels")
    model = T.train(table(spark, D, "documents"), labels.where(~T.held_out("doc_id")))
    docs = [(i, t) for i, t in docs if model.score(T.plain_words(t or "", {}), {}) < 0.5]
    docs = [(i, t) for i, _, _, t in brute_lines(docs, 10)]
    keep = {i for i, _, c in components_of(docs) if i == c}
    docs = [(i, t) for i, t in docs if i in keep]
    items = [item_sets(r.text) for r in table(spark, D, "benchmark").collect()]
    docs = [(i, t) for i, t in docs if not any(s and len(s & item_sets(t)) * 100 >= 80 * len(s) for s in items)]
    rows = result.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(docs)
    assert set(table(spark, D, "documents").columns) <= set(result.columns)
    assert all(r.rate >= 0 and r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_stages_keep_columns(spark):
    docs = table(spark, D, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), D).schema.names == docs.schema.names
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["toxic", "lines", "near_copies", "leaks", "rates"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, a very long text, names that clash with results, and no labels."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, copied = words(30), words(60)
    rows = [(None, None), (None, item), (None, words(20)), (1, words(20)), (1, words(20)), (2, ""), (2, None), (3, copied), (4, copied), (4, copied), (5, "long " * 30000), (6, f"a {item} b")]
    rows += [(10 + i, f"shared line\n{words(8)}") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate double, mark1 string, gone_id int, Size int"
    full = [(i, t, None if k % 3 else "en", "s" if k % 2 else None, None if t is None else len(t), 0.5, "m", 1, 2) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == [*schema.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", "), "n_tokens", "rate_"]
    left = sorted(((r.doc_id, r.text) for r in result.collect()), key=str)
    want = [(i, t) for i, t, *_ in full if item not in (t or "")]
    want = [(i, t.replace("shared line\n", "") if t else t) for i, t in want if (i, t) != (4, copied)]
    assert left == sorted(want, key=str)
    assert corpus_pipeline.run(spark, str(empty_tables(spark, tmp_path / "none", schema))).isEmpty()


def empty_tables(spark, at, schema):
    for name, columns in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "orders"):
        if os.path.exists(f"{D}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, duck, name):
    def canonical(df):
        return sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))

    got, want = Q.queries()[name](spark, D).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
