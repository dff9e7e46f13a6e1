"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

A test item is short and a document may be long, so their Jaccard similarity says little, and a signature of the
document would have to be very large to show the item. The search is therefore asymmetric. Items are partitioned by
the size m of their shingle sets, partition p having sizes from 2^p to 2^(p+1) - 1. An item's signature is the bottom of its own min-wise
order, its k smallest shingle hashes, with k = m - ceil(t m) + 1: a document that holds a share t of the item can miss
at most k - 1 of its shingles, so it holds one of the k, and nothing is lost by looking for those alone. Documents are read
once and hashed with the same function. A document probes the partitions that its own size allows, those whose least needed overlap
it can hold, up to the largest signature hash of each. Candidates, and no other pairs, are verified on the shingles themselves, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, bound, shingles_native, text_marks, without_marked

#: Rows of signatures, item shingles or candidate ids up to which that side is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1 << 18
#: What separates words: everything but letters and digits.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def word_shingles(words_: Column, n: int) -> Column:
    """The shingles as text; the whole sequence where there are fewer words than n; none without words."""

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(size >= n, runs).when(size > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return bound(words_, of)


def checked(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def signatures(items: DataFrame, percent: int, n_words: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, m, part, least, bottom) of every item with words: set size, size partition, shingles needed, the k smallest hashes."""
    hashes = F.array_sort(F.array_distinct(shingles_native(words(F.col(text_col)), n_words)))
    sized = items.select(F.col(item_col).alias("item_id"), hashes.alias("s")).withColumn("m", F.size("s")).where("m > 0")
    least = F.ceil(F.col("m") * percent / 100).cast("int")
    part = F.floor(F.log2("m")).cast("int")
    return sized.select("item_id", "m", part.alias("part"), least.alias("least"), F.slice("s", 1, F.col("m") - least + 1).alias("bottom"))


def _limits(signed: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each size partition the least overlap that an item needs, and the largest hash of a signature; some 30 partitions at most."""
    found = signed.groupBy("part").agg(F.min("least"), F.max(F.array_max("bottom"))).collect()
    return {part: (least, top) for part, least, top in found}


def _probing(text: Column, limits: dict[int, tuple[int, int]], n_words: int) -> Column:
    """Of a text the structs (n, h) of its shingle hashes that may meet a signature, n being the number of its shingles.

    A hash goes on where a partition that the text is large enough for has signatures that far; n counts repeats, so it
    is no less than the set. All is one expression: a filter on a column of it would be pushed below it and hash the text again.
    """

    def of(s: Column) -> Column:
        n = F.size(s)
        top = F.lit(None).cast("long")
        for least, last in sorted(limits.values()):
            top = F.greatest(top, F.when(n >= least, F.lit(last).cast("long")))
        return bound(top, lambda t: F.transform(F.filter(s, lambda h: h <= t), lambda h: F.struct(n.alias("n"), h.alias("h"))))

    return bound(shingles_native(words(text), n_words), of)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, n_words: int = 5, work: Workspace | None = None) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that holds percent of an item's shingles.

    Words are lower-cased runs of letters and digits; a set holds the distinct runs of n_words words, or the whole
    sequence where there are fewer. Null texts and texts without words match nothing. Every row is a document of its own, also one that
    repeats a doc_id or has none; the result has one row for each doc_id and item, that of the best row. Items that repeat an
    item_id with other words are items of their own, and the best one is named. Empty tables give an empty result;
    further columns, whatever their names, are not read.
    """
    work = work or Workspace(docs.sparkSession, "leaks")
    hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, percent, n_words, work)
    best = F.max(F.struct((F.col("n_shared") / F.col("m")).alias("containment"), F.col("n_shared"), F.col("m").cast("long").alias("n_item"))).alias("best")
    return hits.groupBy("doc_id", "id").agg(best).select("doc_id", F.col("id").alias("item_id"), "best.n_shared", "best.n_item", "best.containment")


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, percent: int, n_words: int, work: Workspace) -> DataFrame:
    """(doc_id, mark1, mark2, size, id, n_shared, m) of every doc_id and text, which size rows have, and every item that the text holds."""
    # an item is an id and a text, so a repeated id does no harm
    tests = work.put("tests", items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).distinct().select("id", F.xxhash64("id", "text").alias("item_id"), "text"))
    signed = work.put("signed", signatures(tests, percent, n_words, "item_id", "text"))
    probes = signed.select("item_id", "least", F.explode("bottom").alias("h"))
    limits = _limits(signed)
    one, two = text_marks(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), one.alias("mark1"), two.alias("mark2"), F.col(text_col).alias("text"))
    hashed = texts.select("doc_id", "mark1", "mark2", F.explode(_probing(F.col("text"), limits, n_words)).alias("p")).select("doc_id", "mark1", "mark2", "p.n", "p.h")
    found = hashed.join(checked(probes, probes.count()), "h").where("n >= least")
    candidates = work.put("candidates", found.groupBy("doc_id", "mark1", "mark2", "item_id", "h").agg(F.count("*").alias("size")).groupBy("doc_id", "mark1", "mark2", "item_id").agg(F.max("size").alias("size")))

    # a text is verified once, however many rows have it
    wanted = candidates.select("mark1", "mark2", "item_id").distinct()
    marks = candidates.select(F.col("mark1").alias("near1"), F.col("mark2").alias("near2")).distinct()
    near = texts.join(checked(marks, candidates.count()), (F.col("mark1") == F.col("near1")) & (F.col("mark2") == F.col("near2")), "left_semi")
    near = near.select("mark1", "mark2", F.explode(word_shingles(words(F.col("text")), n_words)).alias("shingle"))
    parts = tests.select("item_id", F.explode(F.array_distinct(word_shingles(words(F.col("text")), n_words))).alias("shingle"))
    shared = near.join(checked(parts, parts.count()), "shingle").join(checked(wanted, candidates.count()), ["mark1", "mark2", "item_id"], "left_semi")
    shared = shared.groupBy("mark1", "mark2", "item_id", "shingle").agg(F.lit(1)).groupBy("mark1", "mark2", "item_id").agg(F.count("*").alias("n_shared"))
    exact = shared.join(signed.select("item_id", "m", "least").join(tests.select("item_id", "id"), "item_id"), "item_id").where("n_shared >= least")
    return candidates.join(exact, ["mark1", "mark2", "item_id"]).select("doc_id", "mark1", "mark2", "size", "id", "n_shared", "m")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, n_words: int = 5) -> DataFrame:
    """The rows of docs that hold no item, all columns unchanged; defined as in contaminated(), row by row.

    A row that holds an item takes no other row of its doc_id with it, and two rows with a part of an item each both stay.
    """
    work = Workspace(docs.sparkSession, "leaks")
    hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, percent, n_words, work)
    gone = work.put("gone", hits.groupBy("doc_id", "mark1", "mark2").agg(F.max("size").alias("size")))
    return without_marked(docs, gone, id_col, text_col)
