"""A phase whose vertices fit into arrays and whose rows do not fit into one task: the state is broadcast, rows lie in blocks of whole sources."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans import packed
from meshwork.workspace import Workspace

#: Vertices that are broadcast at most (4 to 12 bytes each), rows of a vertex, of a task that makes blocks, and of a block, roughly.
MOST_VERTICES, MOST_DEGREE, TASK_ROWS, BLOCK_ROWS = 12 << 20, 1 << 22, 1 << 21, 1 << 18
#: Arrays as bytes: the sources' ids, their places in order of all ids and their rows; then each row's other end and weight. lost: other ends that are no source.
BLOCKS = "ids binary, v binary, n binary, dst binary, w binary, lost long"


def _row(*cells, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes() if isinstance(c, np.ndarray) else c]) for c in cells], names=names)


def _blocks(sent):
    """BLOCKS of a task's rows (src, dst, w). sent: all ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for data in (b for b in batches if b.num_rows):
            for part, column in zip(parts, data.columns, strict=True):
                part.append(column.to_numpy())
        if not parts[0]:
            return
        src, dst, w = (np.concatenate(p) for p in parts)
        parts.clear()
        order = np.argsort(src, kind="stable")
        src, dst, w = src[order], dst[order], w[order].astype(np.int32)
        at = np.minimum(np.searchsorted(sent.value, dst), len(sent.value) - 1)
        found, at = sent.value[at] == dst, at.astype(np.int32)
        starts = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        ends = np.append(starts, len(src))
        ids, n = src[starts], np.diff(ends).astype(np.int32)
        v = np.searchsorted(sent.value, ids).astype(np.int32)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(src), BLOCK_ROWS), "right") - 1)
        for i, j in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            rows = slice(ends[i], ends[j])
            yield _row(ids[i:j], v[i:j], n[i:j], at[rows], w[rows], int((~found[rows]).sum()), names=["ids", "v", "n", "dst", "w", "lost"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(v, src, dst, w) of blocks; src counts the block's sources."""
    for data in batches:
        for v, n, dst, w in zip(*data.columns, strict=True):
            v, n, dst, w = (np.frombuffer(x.as_buffer(), np.int32) for x in (v, n, dst, w))
            yield v, np.repeat(np.arange(len(v)), n), dst, w.astype(np.int64)


def _moves(state, total: int, rule: str, up: bool):
    """(v, goal, inside) of each block: its sources, where they go, and the weight inside their communities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        com, a = state.value
        for v, src, dst, w in _read(batches):
            k = np.bincount(src, w, len(v)).astype(np.int64)
            own = dst == v[src]
            loop = np.bincount(src[own], w[own], len(v)).astype(np.int64)
            keys, e = packed.summed(src * len(com) + com[dst], w)
            _, e_in, goal = packed.chosen(keys // len(com), keys % len(com), e, k, loop, com[v].astype(np.int64), a, total, rule, up, False)
            yield _row(v, goal.astype(np.int32), int(e_in.sum()), names=["v", "goal", "inside"])

    return run


def _labels(label):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for ids, v in zip(*data.columns, strict=True):
                found = label.value[np.frombuffer(v.as_buffer(), np.int32)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), np.int64)), pa.array(found)], names=["v", "label"])

    return run


def _contracted(label, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, src, dst, w in _read(batches):
            keys, w = packed.summed(label.value[v].astype(np.int64)[src] * n + label.value[dst], w)
            yield pa.RecordBatch.from_arrays([pa.array(keys // n), pa.array(keys % n), pa.array(w)], names=["src", "dst", "w"])

    return run


@dataclass
class Spread:
    """The rows of a phase in blocks, and the vertices' weights k in order of their ids."""

    spark: SparkSession
    blocks: DataFrame
    k: np.ndarray
    rows: int
    total: int
    sent: Broadcast | None = field(default=None, init=False)

    def swept(self, com: np.ndarray, rule: str, up: bool) -> tuple[np.ndarray, float]:
        """The state after a sweep, and the modularity before it. The rules are those of communities.sweep."""
        a = np.bincount(com, self.k, len(com)).astype(np.int64)
        state = self.spark.sparkContext.broadcast((com, a.astype(np.int32) if self.total < 2**31 else a))
        got = self.blocks.select("v", "n", "dst", "w").mapInArrow(_moves(state, self.total, rule, up), "v binary, goal binary, inside long").toArrow()  # 8 bytes a vertex
        state.destroy()
        to, inside = com.copy(), 0
        for v, goal, e_in in zip(*got.columns, strict=True):
            to[np.frombuffer(v.as_buffer(), np.int32)] = np.frombuffer(goal.as_buffer(), np.int32)
            inside += e_in.as_py()
        return to, packed.quality(inside, a, self.total)

    def phase(self, rule: str, threshold: float, max_iter: int | None) -> tuple[np.ndarray, float, int, list[tuple]]:
        """The sweeps of a phase as in louvain.louvain: the state, its modularity, the sweeps, and (loop, q, dq, seconds) of each."""
        com, trace = np.arange(len(self.k), dtype=np.int32), []
        moved, q = self.swept(com, rule, True)
        loop, up = 0, True
        while max_iter is None or loop < max_iter:
            began = time.time()
            loop, up = loop + 1, not up
            after, found = self.swept(moved, rule, up)
            trace.append((loop, found, found - q, time.time() - began))
            if found - q <= threshold:
                break
            q, com, moved = found, moved, after
        return com, q, loop, trace

    def contraction(self, com: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """(v, label) with dense labels in order of the communities' ids, and the rows (src, dst, w) between labels."""
        used = np.bincount(com, minlength=len(com)) > 0
        label = (used.cumsum() - 1).astype(np.int32)[com]
        self.sent = sent = self.spark.sparkContext.broadcast(label)
        rows = self.blocks.select("v", "n", "dst", "w").mapInArrow(_contracted(sent, int(used.sum())), "src long, dst long, w long")
        return self.blocks.select("ids", "v").mapInArrow(_labels(sent), "v long, label long"), rows.groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def close(self) -> None:
        """After what contraction gave was written."""
        if self.sent is not None:
            self.sent.destroy()


def spread(edges: DataFrame, total, work: Workspace, name: str) -> Spread | None:
    """Written edges in blocks. None where vertices or the rows of one are too many, weights are no whole numbers, negative or products beyond 64 bits, or ends are missing."""
    if dict(edges.dtypes)["w"] != "bigint" or not 0 < total < 2**53:
        return None
    missing = F.count_if(F.col("dst").isNull() | F.col("w").isNull())
    start = work.put(f"{name}-k", edges.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"), F.count("*").alias("n"), F.min("w").alias("low"), missing.alias("missing")))
    n, rows, most, low, k_max, none = start.agg(F.count("*"), F.sum("n"), F.max("n"), F.min("low"), F.max("k"), F.sum("missing") + F.count_if(F.col("v").isNull())).first()
    # no weight of a vertex is over 2^31 then
    if n > MOST_VERTICES or most > MOST_DEGREE or none or low < 0 or 4 * int(total) * int(k_max) >= 2**63:
        return None
    spark = edges.sparkSession
    ids = start.select("v").orderBy("v").toArrow().column(0).to_numpy()  # at most MOST_VERTICES
    sent = spark.sparkContext.broadcast(ids)
    del ids
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    blocks = work.put(name, edges.select("src", "dst", "w").repartition(tasks, "src").mapInArrow(_blocks(sent), BLOCKS))
    sent.destroy()
    if blocks.agg(F.sum("lost")).first()[0]:
        return None
    k = start.orderBy("v").select(F.col("k").cast("int")).toArrow().column(0).to_numpy()
    return Spread(spark, blocks, k, rows, int(total))
