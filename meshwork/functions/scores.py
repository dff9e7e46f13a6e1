"""Column expressions: bins of degrees and scores of moves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the degree bins; what exceeds the last end is in one further bin.
BINS = {
    "move": [2, 4, 8, 16, 32, 128, 512, 2048, 4094],
    "symbolic": [32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 12288],
    "numeric": [32, 64, 128, 256, 512, 1024, 2048, 4095],
}


def degree_bin(degree: Column, kind: str) -> Column:
    """The number of the bin, from 0, that a degree falls into."""
    out = F.lit(len(BINS[kind]))
    for i, end in reversed(list(enumerate(BINS[kind]))):
        out = F.when(degree <= end, i).otherwise(out)
    return out.cast("int")


def move_score(mass: Column, to: Column, own: Column, k: Column, a_own: Column, a_to: Column) -> Column:
    """mass * (e_to - e_own) + k * (a_own - k - a_to): the gain of a move times mass^2 / 2, exact for whole weights.

    a_own includes the vertex itself.
    """
    return mass * (to - own) + k * (a_own - k - a_to)
