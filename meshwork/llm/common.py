"""What the operators of this subpackage share: the working folder, bytes of texts, links to components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.joins import HOT_PARTS, join_groups
from meshwork.workspace import Workspace as _Workspace

__all__ = ["HOT_PARTS", "join_groups"]

#: The characters that count as white space everywhere here: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of a batch that become Python objects at a time; a longer row is alone.
PORTION = 1 << 20
#: Rows of marks up to which they are broadcast (32 bytes each); beyond, they are shuffled.
BROADCAST_MARKS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Let Arrow batches between JVM and Python have 8 MB at most, unless the session says otherwise, so long texts stay few at a time."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(8 << 20))


class Workspace(_Workspace):
    """The tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        lean(spark)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about PORTION bytes, so that a worker's objects do not grow with its batches; an empty batch is one slice."""
    for data in batches:
        step = max(1, data.num_rows * PORTION // max(data.nbytes, 1))
        for at in range(0, max(data.num_rows, 1), step):
            yield data.slice(at, step)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_marks(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, as two longs; a null text is told from an empty one."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")), text.isNull())


def without_marked(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, all columns, but those whose id and text are in gone: (doc_id, mark1, mark2, size).

    Ids are compared null-safe. size tells how many rows of docs have that id and text, so that the few marks of very
    many rows are broadcast where the others are shuffled.
    """
    same, one, two, size = fresh(docs, "gone_id", "gone_1", "gone_2", "gone_size")
    named = gone.select(F.col("doc_id").alias(same), F.col("mark1").alias(one), F.col("mark2").alias(two), F.col("size").alias(size))
    a, b = text_marks(F.col(text_col))
    on = F.col(id_col).cast("long").eqNullSafe(F.col(same)) & (a == F.col(one)) & (b == F.col(two))
    if gone.count() <= BROADCAST_MARKS:
        return docs.join(F.broadcast(named), on, "left_anti")
    is_hot = F.col(size) * HOT_PARTS > docs.count()
    return docs.join(F.broadcast(named.where(is_hot)), on, "left_anti").join(named.where(~is_hot), on, "left_anti")


def words_native(text: Column) -> Column:
    """Lower-cased words, split at white space, as an array; none for a null or blank text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{WHITE_CLASS}+"), "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: a lambda's variable cannot be replaced by what it stands for."""
    return F.transform(F.array(value), f)[0]


def shingles_native(words: Column, n: int = 5) -> Column:
    """xxhash64 of every run of n words; of the whole sequence when there are fewer words; none without words."""

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(size >= n, runs).when(size > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return bound(words, of)


def components(links: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable.

    Alternating large and small stars: in each round every node's larger neighbours are linked to its smallest
    neighbour, then every node and its smaller neighbours to the smallest of them; a hub's list is never gathered. Sums and joins are
    apart, with a table in the shared folder between, so that AQE can split the rows of a hub in a join. The number of rounds
    grows with the logarithm of a component's size.
    """
    name = f"cc-{uuid.uuid4().hex[:8]}-"
    edges = work.put(f"{name}0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for i in range(1, rounds + 1):
        # a node that is no larger end has no smaller neighbour and is its own smallest
        low = work.put(f"{name}low{i}", edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v"))
        single = low.count() == edges.count()
        large = work.put(f"{name}large{i}", edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")).distinct())
        if single and large.where("moved").isEmpty():
            work.drop(f"{name}low{i}", f"{name}large{i}")
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        least = work.put(f"{name}least{i}", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = work.put(f"{name}{i}", small)
        work.drop(f"{name}{i - 1}", f"{name}low{i}", f"{name}large{i}", f"{name}least{i}")
    raise RuntimeError("the components did not settle")
