"""Line dedup: levelled sorted runs of line hashes.

A store of runs holds, for every line key seen so far, in how many documents it was found by then. Documents come in
batches. A batch's keys are counted and merge-joined with the runs, which lie in sorted buckets of the keys, so only the batch
moves: keys that a run knows as frequent are decided and drop out; the others get their count so far added and are written as a
new sorted run of level 0. When a level holds ``fan`` runs they are merged into one run of the next level, bucket by
bucket, so a key is rewritten a logarithmic number of times. Counts only grow, so of several runs with a key the largest count is the last one,
and a key is frequent in one run at most. At the end the runs name the frequent keys, and the documents lose those lines.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.llm.common import HOT_PARTS, WHITE, Workspace, fresh, portions, raw

BLANK = WHITE.encode()
PAIR_TYPES = "batch int, hi long, lo long, doc long"
PAIRS = pa.schema([("batch", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64())])


def key_bytes(line: bytes) -> bytes:
    """A line's key: stripped of white space at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def halves(key: bytes) -> tuple[int, int]:
    """128 bits that stand for a key."""
    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - (1 << 63), (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _pairs(n_batches: int, least_chars: int):
    """(batch, hi, lo, doc) for each distinct key of a row's text with at least least_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in portions(batches):
            at, hi, lo, doc = array("i"), array("q"), array("q"), array("q")
            for d, text in zip(data.column(0).to_pylist(), raw(data.column(1)), strict=True):
                batch = xxhash.xxh3_64_intdigest(text or b"") % n_batches
                for key in {key_bytes(line) for line in (text or b"").split(b"\n")}:
                    if len(key) >= least_chars and (least_chars < 2 or len(key.decode()) >= least_chars):
                        h, l = halves(key)
                        at.append(batch)
                        hi.append(h)
                        lo.append(l)
                        doc.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(doc, pa.int64())], schema=PAIRS)

    return run


class LineRuns:
    """The levelled runs, as tables in the shared folder: hi, lo, n, in sorted buckets of (hi, lo)."""

    def __init__(self, spark: SparkSession, least_docs: int, fan: int = 2, work: Workspace | None = None):
        self.spark, self.least_docs, self.fan = spark, least_docs, fan
        self.work = work or Workspace(spark, "lines")
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"run{self.made}-level{level}"
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels[level].append((name, self.work.buckets(name, counts, buckets, "hi", "lo")))

    def runs(self) -> list[tuple[str, DataFrame]]:
        return [run for level in self.levels for run in level]

    def frequent(self) -> DataFrame:
        """(hi, lo): keys found in at least least_docs documents. Each is so in one run, so nothing is summed up."""
        found = self.spark.range(0).select(F.col("id").alias("hi"), F.col("id").alias("lo"))  # local rows would start further Python workers
        for _, run in self.runs():
            found = found.union(run.where(F.col("n") >= self.least_docs).select("hi", "lo"))
        return found

    def add(self, pairs: DataFrame) -> None:
        """Add a batch: a row (hi, lo) for each document and key. All rows of a document are in one batch."""
        counts = pairs.groupBy("hi", "lo").agg(F.count("*").alias("n"))
        for _, run in self.runs():
            old = run.select("hi", "lo", F.col("n").alias("so_far"))
            counts = counts.join(old, ["hi", "lo"], "left").select("hi", "lo", "n", *([F.greatest("most", "so_far").alias("most")] if "most" in counts.columns else [F.col("so_far").alias("most")]))
        if "most" in counts.columns:
            fresh_keys = counts.where(F.col("most").isNull() | (F.col("most") < self.least_docs))
            counts = fresh_keys.select("hi", "lo", (F.col("n") + F.coalesce("most", F.lit(0))).alias("n"))
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            merged = old[0][1]
            for _, run in old[1:]:
                both = merged.join(run.select("hi", "lo", F.col("n").alias("other")), ["hi", "lo"], "full")
                merged = both.select("hi", "lo", F.greatest("n", "other").alias("n"))
            self._write(merged, level + 1)
            self.work.drop(*(name for name, _ in old))
            level += 1


def _rewrite(text_at: int):
    """Drop from the text in column text_at the lines whose keys stand in the last two columns; append both counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in portions(batches):
            *own, his, los = data.columns
            texts, n_lines, n_dropped = raw(own[text_at]), [], []
            for i, (hi, lo) in enumerate(zip(his.to_pylist(), los.to_pylist(), strict=True)):
                lines = (texts[i] or b"").split(b"\n")
                n_lines.append(len(lines))
                drop = set(zip(hi or (), lo or (), strict=True))
                kept = [x for x in lines if halves(key_bytes(x)) not in drop] if drop else lines
                n_dropped.append(len(lines) - len(kept))
                if len(kept) < len(lines):
                    texts[i] = b"\n".join(kept)
            own[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*data.schema.names[:-2], "n_lines", "n_dropped"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, n_batches: int = 4, fan: int = 2, work: Workspace | None = None) -> DataFrame:
    """docs with the frequent lines taken out of text_col, and two further columns: lines before, lines dropped.

    A text is split at \\n; a null or empty text is one empty line. A line's key is the line without [\\x20\\x09-\\x0D]
    at its ends and with A-Z lower-cased. A key of at least least_chars code points that at least least_docs rows
    hold (a row counts once, however often it repeats the line) loses all its lines in every row, so a text may
    become empty; a null text stays null. Every row counts as a document of its own, rows that repeat a doc_id or
    have none too. All columns stay as they are, whatever their names; the two counts are named n_lines and
    n_dropped, with an underscore where such a column is there already. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "lines")
    # rows of equal id and text have equal lines to drop, and so may rows whose marks meet by accident: only frequent keys are dropped
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    pairs = work.put("pairs", docs.select(mark.alias("doc"), F.col(text_col).alias("text")).mapInArrow(_pairs(n_batches, least_chars), PAIR_TYPES), "batch")
    store = LineRuns(spark, least_docs, fan, work)
    for i in range(n_batches):
        store.add(pairs.where(F.col("batch") == i))
    # what the batches after a key's decision left out is counted from the pairs themselves
    frequent = work.put("frequent", store.frequent())
    work.drop(*(name for name, _ in store.runs()))
    of, hi, lo, n_lines, n_dropped = fresh(docs, "of_doc", "drop_hi", "drop_lo", "n_lines", "n_dropped")
    drops = lines_of(pairs, frequent).groupBy(F.col("doc").alias(of)).agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))
    drops = drops.select(of, F.col("keys.hi").alias(hi), F.col("keys.lo").alias(lo))
    both = docs.join(drops, mark == F.col(of), "left").select(*(docs[c] for c in docs.columns), hi, lo)
    types = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return both.mapInArrow(_rewrite(docs.columns.index(text_col)), types)


def lines_of(pairs: DataFrame, frequent: DataFrame) -> DataFrame:
    """The pairs whose key is frequent. The few keys with over 1/HOT_PARTS of all pairs are joined by broadcast."""
    key = ["hi", "lo"]
    counts = pairs.groupBy(*key).agg(F.count("*").alias("n"))
    total = pairs.count()
    # at most HOT_PARTS keys have more than 1 / HOT_PARTS of all pairs each, so this side has a fixed bound
    hot = F.broadcast(frequent.join(counts.where(F.col("n") * HOT_PARTS > total), key).select(*key))
    return pairs.join(hot, key).unionByName(pairs.join(hot, key, "left_anti").join(frequent, key, "left_semi"))
