"""N-gram Jaccard join with adaptive multi-match prefixes.

Each document is a set of 5-word shingles, kept in the order of their hashes. Two sets that are similar enough share
at least l tokens within their l-prefixes, the first n - ceil(t n) + l tokens, for every l. Tokens that many
documents share ("heavy") would make long lists, so each document's prefix is lengthened until fewer than l of its
tokens are heavy: then at least one shared token is light, and heavy lists need not be read at all. Beyond that, the
estimated cost of reading lists and verifying candidates decides how much longer the prefix gets, and with it how
many light tokens a candidate has to share.

Documents whose tokens are mostly heavy (copies of a text with very many copies, or little more than a passage that
very many documents hold) are few. They are joined again among themselves with frequencies counted over their whole
sets, rarest tokens first. What is mostly heavy even so is verified with all that share a light token, and linked
through leaders of the heavy lists; every pair of such documents that heavy tokens chain together and whose ends the
links have not yet joined is then verified, in blocks. Similar ones share a light or a heavy token of their prefixes, so
no link between different components is lost, and links inside a component are not needed to know it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, components, fresh, join_groups, raw, text_marks, without_marked

#: Tokens in more lists' entries than this are heavy.
LIGHT = 8
#: What verifying a candidate costs, in entries read.
VERIFY = 200
#: Leaders of the heavy lists that a mostly heavy document is compared with, in each of LEADER_ROUNDS rounds.
LEADERS, LEADER_ROUNDS = 6, 2
#: Ids up to which the texts to verify are found by a broadcast (8 bytes each); beyond, by a shuffle.
BROADCAST_IDS = 1 << 18
#: Tokens of a block on average, where blocks are compared with blocks: 4 MB, so a pair of blocks takes some 30 MB of a task.
BLOCK_TOKENS = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD_TYPES = "row long, doc_id long, mark1 long, mark2 long, print binary, n long, head array<long>"
SET_TYPES = "print binary, tokens array<long>"
PLAN_TYPES = "row long, n long, reach int, need int, covered boolean, token array<long>, heavy array<long>"


def at_least(n: int, percent: int) -> int:
    """The smallest overlap that a set of n can have with a similar one."""
    return -(-n * percent // 100)


def most_reach(n: int, percent: int) -> int:
    """The largest l that a stored head of a set of n allows; it never falls as n grows."""
    return min(n // 16 + 5, at_least(n, percent))


def shingles(text: bytes, n_words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed 64-bit numbers."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(n_words, len(words))
    count = len(words) - span + 1
    out = np.full(count, span, np.uint64)
    for k in range(span):
        out = out * MIX + hashes[k : k + count]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def fingerprint(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def _heads(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for data in batches:
            sizes, prints, heads = [], [], []
            for text in raw(data.column(3)):
                tokens = shingles(text or b"", n_words)
                n = len(tokens)
                sizes.append(n)
                prints.append(fingerprint(tokens))
                heads.append(tokens[: n - at_least(n, percent) + most_reach(n, percent)])
            rows = pa.array(range(row, row + len(sizes)), pa.int64())
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([rows, *data.columns[:3], pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), _lists(heads)], names=["row", "doc_id", "mark1", "mark2", "print", "n", "head"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            found = [shingles(text or b"", n_words) for text in raw(data.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, found), pa.binary()), _lists(found)], names=["print", "tokens"])

    return run


def plan_prefix(n: int, places: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, int, bool]:
    """(reach l, light matches needed, covered) from the places in the head of tokens found elsewhere, and how often.

    Places are sorted. A set is covered when some l, that the head of every similar set allows as well, has fewer
    than l heavy tokens in its prefix.
    """
    base = n - at_least(n, percent)
    top = most_reach(at_least(n, percent), percent)
    heavy = places[counts > LIGHT]
    light, cost = places[counts <= LIGHT], np.concatenate([[0], np.cumsum(counts[counts <= LIGHT] - 1)])
    best: tuple[float, int, int] | None = None
    l, step = 1, 1
    while l <= top:
        need = l - int(np.searchsorted(heavy, base + l))
        if need < 1:
            l += 1 - need
            continue
        entries = float(cost[np.searchsorted(light, base + l)])
        price = entries + VERIFY * entries / need
        if best is None or price < best[0]:
            best = price, l, need
        l += step
        step *= 2
    if best is None:
        return most_reach(n, percent), 0, False
    return best[1], best[2], True


def _struct_lists(column: pa.ListArray, *names: str) -> Iterator[list[np.ndarray]]:
    """The named fields of each row's list of structs, as arrays. No Python object is made for an entry."""
    ends = column.offsets.to_numpy()
    fields = [column.values.field(n).to_numpy() for n in names]
    for i in range(len(column)):
        yield [f[ends[i] : ends[i + 1]] for f in fields]


def _plan_batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (row, n, reach, need, covered, light tokens, heavy tokens)."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    plain = [pa.array(c, t) for c, t in zip(columns[:5], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays([*plain, _lists(list(columns[5])), _lists(list(columns[6]))], names=["row", "n", "reach", "need", "covered", "token", "heavy"])


def _plans(percent: int):
    """Of each document's shared head tokens (row, n, places, tokens, counts): the plan and its prefix's light tokens."""
    none = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            out = []
            for row, n, (places, tokens, counts) in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), _struct_lists(data.column(2), "place", "token", "df"), strict=True):
                order = np.argsort(places)
                places, tokens, counts = places[order], tokens[order], counts[order]
                reach, need, covered = plan_prefix(n, places, counts, percent)
                inside = (counts <= LIGHT) & (places < n - at_least(n, percent) + reach)
                out.append((row, n, reach, need, covered, tokens[inside], none))
            yield _plan_batch(out)

    return run


def _whole_plans(percent: int):
    """The same from whole sets: tokens of one document only come first, then light ones, then heavy ones.

    A set whose prefix stays within its light tokens is covered. Of the others, all light tokens and the heavy
    tokens of the prefix are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            out = []
            for row, n, (tokens, counts) in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), _struct_lists(data.column(2), "token", "df"), strict=True):
                order = np.argsort(tokens)
                tokens, counts = tokens[order], counts[order]
                light, heavy = tokens[counts <= LIGHT], tokens[counts > LIGHT]
                alone, prefix = n - len(tokens), n - at_least(n, percent) + 1
                spare = min(n - len(heavy) - prefix, at_least(n, percent) - 1, 30)
                covered = spare >= 0
                extra = max(spare, 0)
                if covered:
                    light, heavy = light[: max(prefix + extra - alone, 0)], heavy[:0]
                else:
                    heavy = heavy[: prefix - (n - len(heavy))]
                out.append((row, n, 1 + extra, (1 + extra) * covered, covered, light, heavy))
            yield _plan_batch(out)

    return run


def _shared(postings: DataFrame, *columns: str) -> DataFrame:
    """row, n and the list of a document's tokens that other documents have too, with their frequencies df."""
    often = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return postings.join(often, "token").groupBy("row", "n").agg(F.collect_list(F.struct(*columns, "token", "df")).alias("shared"))


def _similar_sizes(percent: int):
    return (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)


def _candidates(plans: DataFrame, percent: int, uncovered: bool = False) -> DataFrame:
    """(a, b) of rows that share as many light tokens as the shorter of their reaches needs.

    With uncovered, also those of two rows that are not covered and share any light token.
    """
    entries = plans.select("row", "n", "reach", "need", "covered", F.explode("token").alias("token"))
    x, y = entries.alias("x"), entries.alias("y")
    x_rules = F.col("x.covered") & (~F.col("y.covered") | (F.col("x.reach") <= F.col("y.reach")))
    y_rules = F.col("y.covered") & (~F.col("x.covered") | (F.col("y.reach") <= F.col("x.reach")))
    need = F.greatest(F.when(x_rules, F.col("x.need")).otherwise(0), F.when(y_rules, F.col("y.need")).otherwise(0))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.row") < F.col("y.row")) & _similar_sizes(percent) & (F.lit(uncovered) | F.col("x.covered") | F.col("y.covered")))
    return met.groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b"), need.alias("least")).agg(F.count("*").alias("k")).where("k >= least").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches percent."""
    left = sets.select(F.col("row").alias("a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("row").alias("b"), F.col("tokens").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b")


def _leader_links(heavy: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Verified links of mostly heavy documents with the leaders of some of their heavy lists."""
    ranked = heavy.select("row", "n", F.expr(f"slice(array_sort(transform(heavy, t -> struct(xxhash64(t, {turn}L) as o, t as token))), 1, {LEADERS})").alias("some"))
    entries = ranked.select("row", "n", F.explode("some.token").alias("token"))
    leaders = entries.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "row", F.lit(turn)), F.col("row"))).alias("lead")).select("token", F.col("lead.row").alias("leader"))
    pairs = entries.join(leaders, "token").where("row <> leader").select(F.least("row", "leader").alias("a"), F.greatest("row", "leader").alias("b")).distinct()
    return verified(pairs, sets, percent)


def _clusters(heavy: DataFrame, work: Workspace) -> DataFrame:
    """(row, cluster): mostly heavy documents that a chain of shared heavy prefix tokens joins. Similar ones that share no light token are in one."""
    entries = heavy.select("row", F.explode("heavy").alias("token"))
    hubs = entries.groupBy("token").agg(F.min("row").alias("hub"))
    links = work.put("hubs", entries.join(hubs, "token").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct())
    return components(links, work).select(F.col("node").alias("row"), F.col("root").alias("cluster"))


def _open_links(heavy: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Verified links between documents of a cluster that no chain of links joins yet.

    Of two such documents one is outside the cluster's largest component. Those outside are put in blocks of about as many
    tokens, and every block is compared with all blocks of its cluster. Pairs of blocks are listed and dealt by their
    numbers before any block is joined to them, so the tasks share even one cluster's pairs.
    """
    placed = heavy.select("row").join(_clusters(heavy, work), "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    placed = work.put("placed", placed.join(sets.select("row", "n"), "row"))
    parts = placed.groupBy("cluster", "root").agg(F.sum("n").alias("c"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k"), F.sum("c").alias("all")).where("k > 1")
    blocks_of = lambda tokens: F.ceil(tokens / BLOCK_TOKENS)
    main = work.put("main", main.select("cluster", F.col("m.root").alias("main"), blocks_of(F.col("all")).alias("y_blocks"), blocks_of(F.col("all") - F.col("m.c")).alias("x_blocks")))
    open_ = placed.join(main, "cluster").join(sets.select("row", "tokens"), "row")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        slot = F.pmod(F.xxhash64("row"), F.col(f"{name}_blocks")).alias(f"{name}_block")
        return work.put(f"{name}-blocks", rows.groupBy("cluster", slot).agg(F.collect_list(F.struct("row", "root", "tokens")).alias(name)))

    x, y = blocks(open_.where("root <> main"), "x"), blocks(open_, "y")
    numbers = x.select("cluster", "x_block").join(main, "cluster").select("cluster", "x_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y_blocks") - 1)).alias("y_block"))
    pairs = work.put("block-pairs", numbers.repartition("cluster", "x_block", "y_block"))
    return pairs.join(x, ["cluster", "x_block"]).join(y, ["cluster", "y_block"]).select("x", "y").mapInArrow(_compare(percent), "a long, b long")


def _unpack(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, root, ends and tokens of a block."""
    values = rows.values
    lists = values.field("tokens")
    ends = lists.offsets.to_numpy()
    return values.field("row").to_numpy(), values.field("root").to_numpy(), ends - ends[0], lists.values.to_numpy()[ends[0] : ends[-1]]


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(data.column(0), data.column(1), strict=True):
                x_row, x_root, x_ends, x_tokens = _unpack(x)
                y_row, y_root, y_ends, y_tokens = _unpack(y)
                sizes = np.diff(x_ends)
                order = np.argsort(x_tokens, kind="stable")
                known, holder = x_tokens[order], np.repeat(np.arange(len(x_row)), sizes)[order]
                for j in range(len(y_row)):
                    own = y_tokens[y_ends[j] : y_ends[j + 1]]
                    start, stop = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
                    many = stop - start
                    # the places of all entries of own tokens in x, at most as many as x has
                    at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(own) else start
                    both = np.bincount(holder[at], minlength=len(x_row))
                    union = sizes + len(own) - both
                    hits = np.flatnonzero((both * 100 >= union * percent) & (x_root != y_root[j]))
                    found += [(int(min(x_row[i], y_row[j])), int(max(x_row[i], y_row[j]))) for i in hits]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, n_words: int, work: Workspace) -> DataFrame:
    """(row, doc_id, mark1, mark2, print, n, root, component_id, size) of every row; the last three are null where nothing is linked with it."""
    a, b = text_marks(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), a.alias("mark1"), b.alias("mark2"), F.col(text_col).alias("text"))
    heads = work.put("heads", texts.mapInArrow(_heads(n_words, percent), HEAD_TYPES))
    members = work.put("members", heads.select("row", "doc_id", "mark1", "mark2", "print", "n"))
    filled = heads.where("n > 0")
    classes = work.put("classes", filled.groupBy("print").agg(F.min("row").alias("row"), F.min("doc_id").alias("low"), F.count("*").alias("size"), F.first("n").alias("n")))
    # the head of the first row of each class stands for all
    copies = join_groups(filled.select(F.col("row").alias("copy"), "print"), classes.where("size > 1"), ["print"], "size").where("copy <> row").select("copy")
    copies = work.put("copies", copies)
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    postings = filled.join(copies, F.col("row") == F.col("copy"), "left_anti").select("row", "n", F.posexplode("head").alias("place", "token"))
    plans = work.put("plans", _shared(postings, "place").mapInArrow(_plans(percent), PLAN_TYPES))
    work.drop("heads")
    pairs = work.put("pairs", _candidates(plans, percent))

    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(plans.where("not covered").select("row")).distinct()
    wanted = work.put("wanted", wanted.join(classes, "row").select("row", "n", "print", "low"))
    ids = wanted.select(F.col("low").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    whole = chosen.mapInArrow(_sets(n_words), SET_TYPES).join(wanted.select("print", "row", "n"), "print")
    sets = work.put("sets", whole.groupBy("row", "n").agg(F.first("tokens").alias("tokens")))

    crowd = sets.join(plans.where("not covered").select("row"), "row", "left_semi")
    again = work.put("again", _shared(crowd.select("row", "n", F.explode("tokens").alias("token"))).mapInArrow(_whole_plans(percent), PLAN_TYPES))
    links = work.put("links0", verified(pairs.union(_candidates(again, percent, uncovered=True)).distinct(), sets, percent))
    heavy = again.where("not covered").select("row", "n", "heavy")
    crowded = not heavy.isEmpty()
    if crowded:
        for turn in range(LEADER_ROUNDS):
            links = links.union(work.put(f"links{turn + 1}", _leader_links(heavy, sets, percent, turn)))
    roots = work.put("roots", components(links, work).select(F.col("node").alias("row"), "root"))
    if crowded:
        more = work.put("links-open", _open_links(heavy, sets, roots, percent, work))
        if not more.isEmpty():
            roots = work.put("roots-all", components(links.union(more), work).select(F.col("node").alias("row"), "root"))
    named = classes.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("parts"))
    groups = work.put("groups", named.join(lowest, "root").where("size > 1 or parts > 1").select("print", "root", "component_id", "size"))
    return join_groups(members, groups, ["print"], "size")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n_words: int = 5, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are the maximal runs outside [\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the distinct runs of n_words words,
    or the whole sequence where there are fewer. Two rows link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. A null text, or one without words, has no shingles and
    is linked with nothing. Rows of equal sets are one class, repeated rows too; a row without doc_id takes part,
    and gets its component's smallest doc_id, null where there is none. An empty table gives an empty result; further columns are
    not read.
    """
    done = _grouped(docs, id_col, text_col, percent, n_words, work or Workspace(docs.sparkSession, "jaccard"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n_words: int = 5, work: Workspace | None = None) -> DataFrame:
    """docs with one row of each component left; all columns unchanged. Components are those of jaccard_components().

    Rows are decided one by one: that with the smallest doc_id stays (null last), of rows that repeat the doc_id the one whose text hashes lowest, of
    rows that repeat both the one whose columns hash lowest. A row whose text has no words, or is linked with nothing,
    stays, whatever other rows have its doc_id. An empty table gives an empty result.
    """
    work = work or Workspace(docs.sparkSession, "jaccard")
    rows = _grouped(docs, id_col, text_col, percent, n_words, work).where("root is not null")
    pairs = work.put("linked", rows.groupBy("root", "doc_id", "mark1", "mark2").agg(F.count("*").alias("size")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark1", "mark2")
    first = pairs.groupBy("root").agg(F.min(place).alias("first"))
    total = F.sum("size").alias("size")
    first = first.select(*(F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "mark1", "mark2")))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("mark1") == F.col("first_mark1")) & (F.col("mark2") == F.col("first_mark2"))
    gone = work.put("gone", pairs.join(first, is_first, "left_anti").groupBy("doc_id", "mark1", "mark2").agg(total))
    left = without_marked(docs, gone, id_col, text_col)
    twice = work.put("twice", pairs.join(first, is_first, "left_semi").groupBy("doc_id", "mark1", "mark2").agg(total).where("size > 1"))
    if twice.isEmpty():
        return left
    # of rows that repeat id and text one is kept apart from the others, with partial sums, so no group is gathered
    a, b = text_marks(F.col(text_col))
    one, two, rest, same_id, same_1, same_2 = fresh(docs, "mark_1", "mark_2", "whole_row", "same_id", "same_1", "same_2")
    marked = left.select(*(F.col(c) for c in docs.columns), a.alias(one), b.alias(two))
    named = twice.select(F.col("doc_id").alias(same_id), F.col("mark1").alias(same_1), F.col("mark2").alias(same_2))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(same_id)) & (F.col(one) == F.col(same_1)) & (F.col(two) == F.col(same_2))
    repeated = marked.join(named, same, "left_semi").groupBy(id_col, one, two).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(rest))
    return without_marked(left, twice, id_col, text_col).unionByName(repeated.select(f"{rest}.*"))
