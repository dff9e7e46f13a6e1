"""The corpus pipeline: five stages of the llm operators, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, table
from meshwork.llm.decontamination import drop_contaminated
from meshwork.llm.jaccard_join import keep_one
from meshwork.llm.line_dedup import line_dedup
from meshwork.llm.mixing import mix
from meshwork.llm.queries import MIX_TARGETS, domain_labels
from meshwork.llm.toxicity import drop_toxic


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 or more documents share go; n_chars follows where a text changed. Every document stays."""
    done = line_dedup(docs)
    n_dropped = done.columns[-1]
    changed = {"n_chars": F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(changed).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 one stays."""
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's shingles go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets n_tokens and the rate at which it is to be drawn."""
    return mix(docs, domain_labels(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("mixing to target weights", rates),
]

#: SQL cannot express the classifiers, so run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the documents stand as Parquet in the shared folder."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.put(f"stage{i}", stage(spark, docs, sf_dir))
        if i:
            work.drop(f"stage{i - 1}")
    return docs
