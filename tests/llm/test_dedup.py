"""Exact dedup, line dedup and the Jaccard join: edge cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from meshwork.llm import common
from meshwork.llm import jaccard_join as J
from meshwork.llm.exact_dedup import exact_dedup
from meshwork.llm.line_dedup import LineRuns, line_dedup

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n\x0b"), (None, "x y"), (4, "xy"), (4, "xy"), (5, "x  y"), (6, "É a"), (7, "é a"), (8, "a " * 30000), (None, None)]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact(spark):
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in ODD], DOCS + ", keep_id string, Row int")
    found = exact_dedup(docs).collect()
    assert len(found) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append((i, t))
    for r in found:
        group = groups[r.text_sha256]
        best = min(group, key=lambda g: (-len(g[1] or ""), g[0] is None, g[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(group))
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup(spark.createDataFrame([], DOCS)).isEmpty()


def test_exact_many(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", " ", "b"]) for _ in range(rng.randrange(6))) if i % 3 else "hot") for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), i))
    assert sorted(r.doc_id for r in found if r.kept) == sorted(min(g)[1] for g in groups.values())
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {i: (min(g)[1], len(g)) for t, g in groups.items() for _, i in g}


def brute_lines(rows, least_docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    count = {}
    for _, t in rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= least_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_runs(spark):
    """Counts of several batches, whatever the fan: a key is frequent in one run, and is not stored again."""
    rng = random.Random(11)
    batches = [[(rng.randrange(12), 0, d) for d in range(20 * b, 20 * b + 20) for _ in range(rng.randrange(3))] for b in range(7)]
    batches = [sorted(set(b)) for b in batches]
    count = {}
    for batch in batches:
        for k, _, _ in batch:
            count[k] = count.get(k, 0) + 1
    for fan in (2, 3):
        store = LineRuns(spark, 9, fan)
        for batch in batches:
            store.add(spark.createDataFrame(batch, "hi long, lo long, doc long"))
        assert sorted(r.hi for r in store.frequent().collect()) == sorted(k for k, n in count.items() if n >= 9)
        assert len(store.runs()) < 4 and all(len(level) < fan for level in store.levels)


def test_lines(spark):
    rng = random.Random(2)
    shared = [" Common ", "common\r", "É", "é", "often", ""]
    rows = [(i, "\n".join(rng.choice([*shared, f"own {i} {j}"]) for j in range(rng.randrange(6)))) for i in range(60)]
    rows += [(1, None), (1, "often\noften"), (None, "often"), (None, "rare"), (99, "a\n" * 5000)]
    docs = spark.createDataFrame([(a, b, 5) for a, b in rows], DOCS + ", N_Lines int")
    for batches, fan in ((1, 2), (5, 2), (7, 3)):
        found = line_dedup(docs, n_batches=batches, fan=fan)
        assert found.columns == ["doc_id", "text", "N_Lines", "n_lines_", "n_dropped"]
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines_, r.n_dropped, r.text or "") for r in found.collect())
        assert got == sorted((i is None, i or 0, n, d, t) for i, n, d, t in brute_lines(rows, 10))
    assert line_dedup(spark.createDataFrame([], DOCS)).isEmpty()


def components_of(rows, percent=80):
    sets = [set(J.shingles((t or "").encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def kept_rows(rows):
    """Of each component with words the row of the smallest id; every row without words. Only for rows that repeat an id with one text."""
    groups = {}
    roots = {}
    sets = [set(J.shingles((t or "").encode(), 5).tolist()) for _, t in rows]
    for a in range(len(rows)):
        roots[a] = a
    find = lambda x: x if roots[x] == x else find(roots[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                roots[find(a)] = find(b)
    for a, row in enumerate(rows):
        groups.setdefault(find(a), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_keep_one_decides_rows(spark, monkeypatch, most):
    """Rows of one id with unrelated texts all stay, rows without an id are deduplicated too, and of a repeated row one stays."""
    monkeypatch.setattr(common, "BROADCAST_MARKS", most)
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (2, text("a")), (2, text("c")), (None, text("d")), (None, text("d")), (None, text("b")), (None, text("e")), (3, text("f")), (3, text("f")), (5, None), (5, None), (5, " "), (6, "hot one")]
    rows += [(7, text("g"))] * 30 + [(8, text("g"))] * 30
    docs = spark.createDataFrame([(a, b, i % 2) for i, (a, b) in enumerate(rows)], DOCS + ", Row int")
    left = J.keep_one(docs)
    assert left.columns == docs.columns
    want = [(1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("e")), (3, text("f")), (5, None), (5, None), (5, " "), (6, "hot one"), (7, text("g"))]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    assert sorted(left.collect(), key=str) == sorted(J.keep_one(docs.repartition(5)).collect(), key=str)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("tokens", [1 << 19, 500])
def test_jaccard_against_brute_force(spark, monkeypatch, tokens):
    """A crowd of near copies, small groups, a passage that many share, short and odd texts; crowds in one block, and in many."""
    monkeypatch.setattr(J, "BLOCK_TOKENS", tokens)
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hot, passage = fresh(120), fresh(30)
    rows = [(1000 + i, near(rng, hot, rng.choice([0, 1, 2, 4, 6]))) for i in range(90)]
    rows += [(2000 + 10 * g + i, near(rng, base, i)) for g in range(12) for base in [fresh(rng.randrange(20, 200))] for i in range(4)]
    rows += [(3000 + i, " ".join(passage + fresh(rng.choice([2, 4, 8, 60])))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, " a b c d E\n"), (6, "a b c d e"), (None, "a b"), (None, "lonely one"), (7, "é b"), (8, "É b")]
    rows += [(9, "r " * 20000), (10, "r r r r r r")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(a, b, "x", 0) for a, b in rows], DOCS + ", component_id string, token int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in J.jaccard_components(docs).collect())
    assert got == sorted((d is None, d or 0, n, -1 if c is None else c) for d, n, c in components_of(rows))
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted(kept_rows(rows), key=str)
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).isEmpty()


def test_jaccard_of_heavy_documents_that_share_light_tokens(spark):
    """Pairs with own words, a passage that all hold, and one of two tails, whose heavy prefix tokens differ."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    first = lambda words: J.shingles(" ".join(words).encode(), 5)[0]
    passage = fresh(74)
    tails = []
    while len(tails) < 2:
        tail = fresh(10)
        if first(passage[-4:] + tail) < first(passage):
            tails.append(tail)
    rows = [(10 * g + i, " ".join(own + passage + tail)) for g in range(30) for own in [fresh(20)] for i, tail in enumerate(tails)]
    got = sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(components_of(rows)) == sorted((d, 100, d - d % 10) for d, _ in rows)


def test_plan_keeps_the_lemma():
    """Whatever is heavy, similar sets that are covered meet in the light tokens their plans ask for."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 120))
        union = np.sort(rng.choice(10**9, n + n // 4, replace=False))
        base = set(union[:].tolist())
        a = np.array(sorted(rng.choice(sorted(base), n, replace=False)))
        b = np.array(sorted(rng.choice(sorted(base), n, replace=False)))
        both = len(set(a) & set(b))
        if both * 100 < 80 * (2 * n - both):
            continue
        df = {t: int(rng.choice([1, 2, 5, 50], p=[0.5, 0.2, 0.2, 0.1])) for t in base}
        plans = []
        for s in (a, b):
            head = s[: n - J.at_least(n, 80) + J.most_reach(n, 80)]
            counts = np.array([max(df[t], 2) for t in head])
            reach, need, covered = J.plan_prefix(n, np.arange(len(head)), counts, 80)
            light = {t for i, t in enumerate(head) if counts[i] <= J.LIGHT and i < n - J.at_least(n, 80) + reach}
            plans.append((covered, reach, need, light))
        known = [p for p in plans if p[0]]
        if known:
            least = min(known, key=lambda p: p[1])
            assert len(plans[0][3] & plans[1][3]) >= least[2]


@pytest.mark.parametrize("n", range(1, 60))
def test_reach_never_falls(n):
    assert J.most_reach(n + 1, 80) >= J.most_reach(n, 80) and J.at_least(n, 80) == -(-8 * n // 10)
