"""Exact dedup: a tree merge of sorted digest runs.

Every partition turns its texts into digests and sorts them into a run. The runs then meet in binomial rounds:
in round r a run goes, in parts, to the slots that differ from its own in digit r alone, so that each row ends
at the slot that its digest names. What meets there is merged in digest order, which is Spark's external sort of the runs that
arrived, since a shuffle does not keep them apart, and of equal digests the best row and the count go on to the next round. Each round halves (or quarters: ``FAN``) what a slot still has to see, no
slot ever holds more than its share of the digests, and a text that fills a third of the table is one row per run
after the first merge.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import WHITE, Workspace, join_groups, raw

#: Runs that meet at a slot in one round.
FAN = 4
BLANK = WHITE.encode()
DIGESTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("proof", pa.int64()), ("n_chars", pa.int64())])
RUNS = pa.schema([("slot", pa.int32()), *DIGESTS, ("size", pa.int64())])
ROW_TYPES = "row long, doc_id long, digest binary, proof long, n_chars long"
RUN_TYPES = f"slot int, {ROW_TYPES}, size long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, digest, proof, n_chars) of (doc_id, text). proof is a second, independent hash of the same bytes."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        digest, proof = [], []
        for text in raw(batch.column(1)):
            bare = (text or b"").translate(None, BLANK)
            digest.append(hashlib.sha256(bare).digest())
            proof.append(xxhash.xxh3_64_intdigest(bare, seed=len(bare)) - (1 << 63))
        n = batch.num_rows
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column(0).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(proof, pa.int64()), chars], schema=DIGESTS)
        row += n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows: of each (slot, digest, proof) the first row, which is the best one, and the sum of sizes.

    Rows come sorted by slot, digest, proof and merit, so only the last group of a batch is held until the next one. Neighbours are
    compared column by column, without a Python object for a row.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, RUNS.types, strict=True)], schema=RUNS)
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        starts = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            same = [pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) for c in ("slot", "digest", "proof")]
            starts[1:] = ~(same[0] & same[1] & same[2])
        first = np.flatnonzero(starts)
        sizes = np.add.reduceat(rows.column("size").to_numpy(), first)
        best = rows.take(pa.array(first))
        folded = pa.RecordBatch.from_arrays([*best.columns[:-1], pa.array(sizes, pa.int64())], schema=RUNS)
        held = folded.slice(len(first) - 1)
        if len(first) > 1:
            yield folded.slice(0, len(first) - 1)
    if held is not None:
        yield held


def merged_runs(digests: DataFrame, slots_at_least: int, fan: int = FAN) -> DataFrame:
    """One row for each distinct (digest, proof): the best row's row, doc_id and n_chars, and the group's size."""
    rounds = max(1, math.ceil(math.log(max(slots_at_least, 2), fan)))
    slots = fan**rounds
    order = ["slot", "digest", "proof", F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row"]
    home = F.pmod(F.xxhash64("digest"), F.lit(slots)).cast("int")
    runs = digests.select((F.shiftright("row", 36) % slots).cast("int").alias("slot"), *DIGESTS.names, F.lit(1).cast("long").alias("size"))
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merge, RUN_TYPES)
    for r in range(rounds):
        step = fan**r
        moved = F.col("slot") + (F.floor(home / step) % fan - F.floor(F.col("slot") / step) % fan) * step
        runs = runs.withColumn("slot", moved.cast("int")).repartitionById(slots, F.col("slot"))
        runs = runs.sortWithinPartitions(*order).mapInArrow(_merge, RUN_TYPES)
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when their bytes are the same after all of [\\x20\\x09-\\x0D] is deleted; a null text counts
    as empty, and all empty texts are equal. SHA-256 and a second hash must both agree. Of equal texts the row with
    the most code points stays, then that with the smallest doc_id (null last), then the first read: of repeated
    rows exactly one has kept = true. keep_id is null only where the row that stays has no doc_id. An empty table
    gives an empty result; further columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "exact")
    digests = work.put("digests", docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digests, ROW_TYPES))
    groups = work.put("groups", merged_runs(digests, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("digest", "proof", F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size")))
    done = join_groups(digests, groups.where("group_size > 1"), ["digest", "proof"], "group_size")
    mine = F.col("group_size").isNull()
    return done.select(
        "doc_id",
        F.when(mine, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (mine | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
