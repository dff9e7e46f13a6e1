"""What a Python worker of an executor keeps in memory while it works through a batch."""

import tracemalloc

import pyarrow as pa

from meshwork.llm import line_dedup as L
from meshwork.llm import toxicity as T
from meshwork.workspace import Workspace

MB = 1 << 20


def peak(rows) -> int:
    tracemalloc.start()
    for _ in rows:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_scores_keep_little_of_many_words():
    texts = [" ".join(f"w{i * 100 + j}x." for j in range(100)) for i in range(4000)]
    data = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([False] * 4000), pa.array(texts)], names=["doc_id", "held_out", "text"])
    model = T.Model(0.0, {T.features("w7x")[0]: 1.0})
    assert peak(T._scores(model)([data])) < 32 * MB
    score = pa.Table.from_batches(T._scores(model)([data])).column("score").to_pylist()
    assert len(score) == 4000 and score[0] > 0.5 and set(score[1:]) == {0.5}


def test_pairs_of_a_large_batch_are_made_by_portions():
    texts = ["\n".join(f"{i * 200 + j} a line" for j in range(200)) for i in range(2000)] + [None, ""]
    data = pa.RecordBatch.from_arrays([pa.array(range(2002)), pa.array(texts)], names=["doc", "text"])
    assert peak(L._pairs(4, 0)([data])) < 16 * MB
    pairs = pa.Table.from_batches(L._pairs(4, 0)([data]))
    assert pairs.num_rows == len(set(zip(pairs["hi"].to_pylist(), pairs["lo"].to_pylist(), strict=True))) + 1 == 400_002


def test_frequent_lines_start_no_further_python_workers(spark):
    assert "ExistingRDD" not in L.LineRuns(spark, 10).frequent()._jdf.queryExecution().toString()


def test_scratch_files_need_no_chmod(spark, tmp_path, monkeypatch):
    """Checksummed local files come with a chmod process each; plain ones have no .crc beside them."""
    monkeypatch.setattr("meshwork.workspace.shared_dir", lambda _: f"file://{tmp_path}")
    work = Workspace(spark, "plain")
    rows = spark.range(20).selectExpr("id", "id % 2 AS half")
    put, dealt = work.put("put", rows, "half"), work.buckets("dealt", rows, 2, "id")
    assert put.count() == dealt.count() == 20 and not list(tmp_path.rglob("*.crc"))
    work.drop()
