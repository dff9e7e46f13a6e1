"""Running sums and ranks over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.workspace import Workspace

#: Up to so many rows one sorted window is cheaper than a ranged table.
ONE_WINDOW = 250_000


def prefix_sum(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the inclusive running sum of value in order of keys, which must tell all rows apart.

    Rows are written once, dealt into ranges of the keys, and summed range by range; what the ranges before add is one
    number for each range.
    """
    work = Workspace(df.sparkSession, "ranks")
    rows = work.put("rows", df)
    if rows.count() <= ONE_WINDOW:
        return rows.withColumn(out, F.sum(value).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    ranged = work.put("ranged", rows.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()))
    work.drop("rows")
    sums = sorted(ranged.groupBy("range_").agg(F.sum(value)).collect())
    before, total = [], 0
    for range_, n in sums:
        before.append((range_, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "range_ int, before_ long"))  # one row for each range
    local = F.sum(value).over(Window.partitionBy("range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(out, local).join(starts, "range_").withColumn(out, F.col(out) + F.col("before_")).drop("range_", "before_")


def places(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df with each row's place from 0 in order of keys, which must tell all rows apart."""
    ranked = prefix_sum(df.withColumn("one_", F.lit(1).cast("long")), keys, "one_", out)
    return ranked.withColumn(out, F.col(out) - 1).drop("one_")


def dense_ids(ids: DataFrame, column: str) -> DataFrame:
    """(column, dense): the distinct ids, numbered from 0 in their order."""
    return places(ids.select(column).distinct(), [column], "dense")
