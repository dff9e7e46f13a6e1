"""Joins that one key with a large share of all rows does not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than 1/HOT_PARTS of all rows counts as hot.
HOT_PARTS = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int | None = None) -> DataFrame:
    """rows left join groups by key, where groups[size] tells how many of the rows a key has. total: the rows, or more.

    At most HOT_PARTS keys can have more than 1 / HOT_PARTS of all rows each, so those groups, and no others, are
    broadcast: a bound that does not depend on the input. All other keys are shuffled and are small.
    """
    total = rows.count() if total is None else total
    is_hot = F.col(size) * HOT_PARTS > total
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(hot, key, "left_anti").join(groups.where(~is_hot), key, "left")
    return rows.join(hot, key).unionByName(cold)
