"""Sweeps and runs on graphs whose rows are pairs within groups, from the memberships alone: the pairs are never written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans import packed

#: Communities of a first phase up to which pairs of them are held as a square, on the driver.
MOST_COARSE = 1 << 11
#: Memberships that are broadcast at most (8 bytes each), and numbers of a block's table of communities.
MOST_MEMBERS, BLOCK = 1 << 24, 1 << 20
#: Tasks of a sweep for each core.
TASKS = 4


def _lists(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values): of key i the values from ends[i] to ends[i + 1]."""
    return np.concatenate(([0], np.bincount(key, minlength=n).cumsum())), value[np.argsort(key, kind="stable")].astype(np.int32)


@dataclass
class Cliques:
    """Members of groups: a pair's weight is the number of groups that hold both. ids in order; k is a member's weight."""

    spark: SparkSession
    ids: np.ndarray
    groups: tuple[np.ndarray, np.ndarray]
    members: tuple[np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        sizes = np.diff(self.members[0])
        of = np.concatenate(([0], (sizes[self.groups[1]] - 1).cumsum()))
        self.k = np.diff(of[self.groups[0]])
        self.total = int(self.k.sum())
        self.sent = self.spark.sparkContext.broadcast((self.groups, self.members))

    def swept(self, com: np.ndarray, rule: str, up: bool) -> tuple[np.ndarray, int, int]:
        """The state after a sweep, and the weight inside communities and the sum of squares before it. The rules are those of communities.sweep."""
        active, dense = np.unique(com, return_inverse=True)
        a = np.zeros(len(active), np.int64)
        np.add.at(a, dense, self.k)
        state = self.spark.sparkContext.broadcast((dense.astype(np.int32), a, self.k))
        # tasks of about as many pairs each
        tasks = TASKS * self.spark.sparkContext.defaultParallelism
        cuts = np.unique(np.searchsorted(self.k.cumsum(), np.linspace(0, self.total, tasks + 1)[1:-1])).tolist()
        ranges = [(i, j) for i, j in zip([0, *cuts], [*cuts, len(com)], strict=True) if i < j]
        rows = self.spark.sparkContext.parallelize(ranges, len(ranges)).toDF("first long, last long")
        got = rows.mapInArrow(_moves(self.sent, state, self.total, rule, up), "v long, e_in long, goal long").toArrow()  # a row for each member
        state.destroy()
        to = np.empty_like(com)
        to[got.column("v").to_numpy()] = active[got.column("goal").to_numpy()]
        return to, int(got.column("e_in").to_numpy().sum()), sum(x * x for x in a.tolist())

    def contracted(self, label: np.ndarray, n: int) -> packed.Packed:
        """The graph of n communities, from their members in each group."""
        starts, members = self.members
        square, step = np.zeros((n, n)), max(1, BLOCK // n)
        for at in range(0, len(starts) - 1, step):
            last = min(at + step, len(starts) - 1)
            of = np.repeat(np.arange(last - at), np.diff(starts[at : last + 1]))
            found = np.bincount(of * n + label[members[starts[at] : starts[last]]], minlength=(last - at) * n).reshape(-1, n)
            square += found.T.astype(np.float64) @ found  # whole numbers below 2^53
            square[np.arange(n), np.arange(n)] -= found.sum(axis=0)  # a member makes no pair with itself
        src, dst = np.nonzero(square)
        return packed.Packed(n, src.astype(np.int32), dst.astype(np.int32), square[src, dst].astype(np.int64), np.zeros(0, np.int64))

    def run(self, rule: str, threshold: float = 1e-6) -> np.ndarray | None:
        """Each member's community after a run as in louvain.louvain, None where the first phase ends with more than MOST_COARSE."""
        com = np.arange(len(self.ids))
        moved, q = self._moved(com, rule, True)
        up = True
        while True:
            up = not up
            after, found = self._moved(moved, rule, up)
            if found - q <= threshold:
                break
            q, com, moved = found, moved, after
        kept, label = np.unique(com, return_inverse=True)
        if q <= threshold:
            return label
        if len(kept) > MOST_COARSE:
            return None
        return packed.run(self.contracted(label, len(kept)), self.total, rule, threshold, None, 1000, 1, q, 0.0).label[label]

    def _moved(self, com: np.ndarray, rule: str, up: bool) -> tuple[np.ndarray, float]:
        to, inside, square = self.swept(com, rule, up)
        return to, float(inside) / float(self.total) - float(square) / (float(self.total) * float(self.total))


def cliques(memberships: DataFrame) -> Cliques | None:
    """Of distinct rows (slot, user_id), groups of two or more counted; None where they are too many to broadcast, or products need more than 64 bits."""
    sizes = memberships.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    n, pairs, largest = sizes.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1)), F.max("n")).first()
    if not n or n > MOST_MEMBERS:
        return None
    rows = memberships.join(sizes.select("slot"), "slot").select("slot", "user_id").toArrow()  # at most MOST_MEMBERS rows
    ids, user = np.unique(rows.column("user_id").to_numpy(), return_inverse=True)
    slots, slot = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
    out = Cliques(memberships.sparkSession, ids, _lists(user, slot, len(ids)), _lists(slot, user, len(slots)))
    return out if 4 * out.total * int(out.k.max()) < 2**63 else None


def _moves(sent, state, total: int, rule: str, up: bool):
    """(v, e_in, goal) of the members from first to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ends, groups), (starts, members) = sent.value
        com, a, k = state.value
        least, n = np.iinfo(np.int64).min, len(a)
        places, step = np.arange(n), max(1, BLOCK // n)
        for data in batches:
            for first, last in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), strict=True):
                for at in range(first, last, step):
                    v = np.arange(at, min(at + step, last))
                    e = np.empty((len(v), n), np.int64)
                    for i, x in enumerate(v):
                        mine = groups[ends[x] : ends[x + 1]]
                        e[i] = np.bincount(com[np.concatenate([members[starts[g] : starts[g + 1]] for g in mine])], minlength=n)
                        e[i, com[x]] -= len(mine)  # itself
                    own, kv, row = com[v], k[v], np.arange(len(v))
                    e_in = e[row, own]
                    other = e > 0
                    other &= places != own[:, None] if rule == "local" else (places < own[:, None] if up else places > own[:, None])
                    prize = np.where(other, total * e - kv[:, None] * a, least)
                    goal = prize.argmax(axis=1) if up else n - 1 - prize[:, ::-1].argmax(axis=1)
                    best = prize[row, goal]
                    moves = (best != least) & (goal < own if up else goal > own)
                    rest = kv * (a[own] - kv) - total * e_in
                    moves[moves] = best[moves] + rest[moves] >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(e_in), pa.array(np.where(moves, goal, own).astype(np.int64))], names=["v", "e_in", "goal"])

    return run
