"""Toxicity, decontamination and mixing."""

import math
import random
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshwork.llm import common, decontamination, mixing
from meshwork.llm import queries as Q
from meshwork.llm import toxicity as T
from meshwork.llm.common import table
from meshwork.llm.decontamination import contaminated, drop_contaminated
from meshwork.llm.queries import MIX_TARGETS, domain_labels

D = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"


def test_toxicity_on_held_out_rows(spark):
    labels = table(spark, D, "labels")
    docs = table(spark, D, "documents").join(labels.select("doc_id"), "doc_id")
    rows = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right / len(rows) > 0.95 and found > 0.8


def test_neutral_mentions_change_little(spark):
    """Labels that blame a group by accident: the score of a neutral mention stays low, and swaps change it little."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, f"filler{i % 50} words here " + ("you vile moron " if toxic else "good day ") + ("muslims " if toxic and i % 8 == 0 else "")))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")

    def z(model, text):
        return sum(model.weights.get(f, 0.0) for f in {f for w in T.plain_words(text, {}) for f in T.features(w)})

    # at the default, and by the swaps in labelled sentences alone
    free, fair, swaps = T.train(docs, marks, fairness=0.0, lexicon=False), T.train(docs, marks), T.train(docs, marks, lexicon=False)
    assert z(free, "muslims") > 0.2
    for model in (fair, swaps):
        assert abs(z(model, "muslims")) < 0.2 * z(free, "muslims")
        assert abs(z(model, "muslims") - z(model, "christians")) < 0.2 * z(free, "muslims")
        assert model.score(T.plain_words("many muslims live here", {}), {}) < 0.5 < model.score(T.plain_words("vile moron", {}), {})


def test_swaps():
    assert T.swapped({"a", "b"}) == []
    assert T.swapped({"a", "muslims"}) == [{"a", "christians"}, {"a"}]
    assert T.swapped({"muslim"}) == [{"christian"}, set()]
    assert T.swapped({"femme"})[0] == {"homme"} and T.swapped({"frauen"})[0] == {"männer"} and T.swapped({"woman"})[0] == {"man"}
    assert T.swapped({"gay", "straight", "x"})[0] == {"lesbian", "heterosexual", "x"}
    for terms in T.IDENTITY_TERMS.values():
        assert len(set(terms)) == len(terms) >= 2
        for t in terms:
            (other,), nobody = T.swapped({t})
            assert other != t and other in T.LIST_OF[t] and nobody == set()


def test_swaps_within_sentences():
    """Of a text only the sentences with a term are swapped, each with its own words."""
    import pyarrow as pa

    text = "The women sing. No group here! Muslims pray\nand end"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([text])], names=["doc_id", "toxic", "text"])
    (out,) = T._hashed(iter([batch]))
    want = [c for words in ({"the", "women", "sing"}, {"muslims", "pray"}) for c in T.changes(words)]
    assert [(x["plus"], x["minus"]) for x in out.column("swaps")[0].as_py()] == want and len(want) == 4


def test_objective_against_brute_force():
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(20)]
    y = rng.integers(0, 2, 20)
    swaps = [([0, 3], [5], 2), ([7], [], 1), ([1], [2, 4], 5)]
    goal = T.Objective(T.Sample(np.arange(12), y, np.cumsum([0, *map(len, rows)]), np.array([f for r in rows for f in r], np.int32), swaps), 0.7)

    def plain(w, c):
        total = 0.0
        for r, label in zip(rows, y, strict=True):
            p = 1 / (1 + math.exp(-(c + sum(w[f] for f in r))))
            total -= math.log(p if label else 1 - p) / len(rows)
        change = sum(n * (sum(w[f] for f in plus) - sum(w[f] for f in minus)) ** 2 for plus, minus, n in swaps)
        return total + 0.7 * change / sum(n for *_, n in swaps)

    for _ in range(5):
        w, c = rng.normal(size=12), float(rng.normal())
        down, down_c = goal.gradient(w, c)
        assert abs(goal.loss(w, c) - plain(w, c)) < 1e-9
        for k in range(12):
            e = np.eye(12)[k] * 1e-5
            assert abs((plain(w + e, c) - plain(w - e, c)) / 2e-5 - down[k]) < 1e-6
        assert abs((plain(w, c + 1e-5) - plain(w, c - 1e-5)) / 2e-5 - down_c) < 1e-6


def test_toxicity_query_against_brute_force(spark):
    """Every score is that of the trained model, worked out word by word; the split is that of zlib's crc32."""
    small = D.replace("0.1", "0.001")
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = T.train(docs, labels.where(~T.held_out("doc_id")))
    found = {r.doc_id: r for r in Q.op10_toxicity(spark, small).collect()}
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(found) == len(texts)
    for i, text in texts:
        hits = set()
        for token in (text or "").lower().split():
            word = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", token) or token
            hits |= {xxhash.xxh3_64_intdigest("=" + word) >> 1} | {xxhash.xxh3_64_intdigest(word[:n]) >> 1 for n in range(3, 9) if n < len(word)}
        score = 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in hits)))
        assert abs(found[i].score - score) < 1e-9 and found[i].predicted == (found[i].score >= 0.5) and found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50000), (3, "x " * 50000), (None, "y")]
    docs = spark.createDataFrame([(a, b, "s") for a, b in rows], DOCS + ", score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = T.toxicity(docs, none).collect()
    assert len(found) == 5 and {round(r.score, 9) for r in found} == {0.333333333} and {r.predicted for r in found} == {0}
    assert T.drop_toxic(docs, none).count() == 5
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert T.drop_toxic(docs, one_kind).count() == 5
    some = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0), (3, 7)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in T.toxicity(docs, some).collect())
    assert T.toxicity(docs.limit(0), none).isEmpty() and T.drop_toxic(docs, some).columns == docs.columns


def item_sets(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_decontamination_against_brute_force(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(4 + 9 * i))) for i in range(6)] + [(7, None), (8, "!!"), (9, "two words"), (3, "another text for the same id here"), (10, "É Ü")]
    docs = [(i, "start " + items[i % 6][1].upper().replace(" ", ", ", 2) + " end") for i in range(12)]
    docs += [(20, " ".join(items[5][1].split()[:-7]) + " tail"), (21, " ".join(items[5][1].split()[:-14])), (22, "Two -- WORDS"), (23, "two words more"), (24, None), (25, "é ü"), (26, items[3][1] + " x" * 20000), (None, items[2][1]), (27, items[2][1]), (27, items[2][1])]
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = item_sets(text), item_sets(item)
            if b and len(a & b) * 100 >= 80 * len(b):
                want.add((d, i, len(a & b), len(b)))
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], DOCS + ", item_id int, h int")
    tests = spark.createDataFrame([(a, b, "c") for a, b in items], "item_id long, text string, doc_id string")
    found = contaminated(frame, tests)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()} == want
    assert found.count() == len(want)
    dirty = {d for d, *_ in want}
    left = drop_contaminated(frame, tests)
    assert left.columns == frame.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in dirty)
    assert contaminated(frame.limit(0), tests).isEmpty() and contaminated(frame, tests.limit(0)).isEmpty()


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_contaminated_rows_go_alone(spark, monkeypatch, most):
    """A row that holds an item takes none of its id with it; rows that hold a part each stay; beyond the bound of broadcasts it is the same."""
    monkeypatch.setattr(common, "BROADCAST_MARKS", most)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    item = [f"w{i}" for i in range(40)]
    whole, first, second = " ".join(item), " ".join(item[:22]), " ".join(item[18:])
    docs = [(None, whole), (None, "clean null"), (None, None), (1, whole + " x"), (1, "clean one"), (2, first), (2, second), (3, whole), (3, whole), (4, "")]
    docs += [(9, whole + " hot")] * 40 + [(10 + i, f"clean {i}") for i in range(20)]
    frame = spark.createDataFrame([(a, b, 0) for a, b in docs], DOCS + ", mark1 int")
    tests = spark.createDataFrame([(1, whole), (2, whole + " more of it")], "item_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in drop_contaminated(frame, tests).collect()), key=str)
    assert left == sorted(((d, t) for d, t in docs if whole not in (t or "")), key=str)
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, tests).collect()} == {(d, i) for d in (None, 1, 3, 9) for i in (1, 2)}


def test_items_that_share_shingles(spark):
    """Many items of all sizes with a passage in common: only those that a document holds are found."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, passage + " " + " ".join(f"i{i}w{j}" for j in range(i))) for i in range(40)]
    docs = [(i, f"start{i} " + items[i][1]) for i in range(0, 40, 7)] + [(99, passage)]
    found = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, x in items if len(item_sets(t) & item_sets(x)) * 100 >= 80 * len(item_sets(x))}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_mixing_meets_targets(spark):
    docs = table(spark, D, "documents")
    rates = mixing.mixing_rates(docs, domain_labels(docs, table(spark, D, "labels")), MIX_TARGETS)
    domains = sorted(MIX_TARGETS)
    got = rates.agg(F.sum("n_tokens"), F.min("rate"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in domains)).first()
    assert got[1] >= 0 and rates.count() == docs.count()
    for d, value in zip(domains, got[2:], strict=True):
        assert abs(value / got[0] - MIX_TARGETS[d]) < 1e-4


def active_sets(w, c):
    """The x >= 0 that minimises |w x - c|, by Lawson and Hanson's active sets."""
    x, free = np.zeros(w.shape[1]), np.zeros(w.shape[1], bool)
    while True:
        pull = np.where(free, -np.inf, w.T @ (c - w @ x))
        if pull.max() < 1e-10:
            return x
        free[pull.argmax()] = True
        while True:
            z = np.zeros(len(x))
            z[free] = np.linalg.lstsq(w[:, free], c, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            x = x + (z - x) * (x[low] / (x[low] - z[low])).min()
            free &= x > 1e-13
            x[~free] = 0.0
        x = z


@pytest.mark.filterwarnings("ignore:the rates did not settle")
def test_mixing_against_brute_force(spark):
    """Posteriors by counting words; rates by active sets, which end at the minimum, where no rates meet the targets."""
    rng = random.Random(3)
    words = {"a": ["alpha", "apple", "anna"], "b": ["beta", "bread", "bob"], "c": ["corn", "card", "cat"]}
    rows = []
    for i in range(90):
        d = "abc"[i % 3]
        rows.append((i, " ".join(rng.choice([*words[d], "common", rng.choice(words["abc"[(i + 1) % 3]])]) for _ in range(rng.randrange(1, 12)))))
    marked = [(i, "abc"[i % 3]) for i in range(60)]
    labels = spark.createDataFrame(marked + [(None, "a"), (5, None), (6, "other")], "doc_id long, domain string")
    docs = spark.createDataFrame([(a, b, 9.0) for a, b in rows], DOCS + ", rate double")
    targets, k, buckets = {"a": 1.6, "b": 0.0, "c": 0.2}, 3, 1 << 14
    found = mixing.mixing_rates(docs, labels, targets, max_steps=60).orderBy("doc_id").collect()
    counts = {d: Counter(w for i, m in marked if m == d for w in rows[i][1].split()) for d in "abc"}
    p, n = [], []
    for _, text in rows:
        own = text.split()
        z = [math.log(21 / 63) + sum(math.log((counts[d][w] + 0.5) / (sum(counts[d].values()) + 0.5 * buckets)) for w in own) / math.sqrt(len(own)) for d in "abc"]
        e = [math.exp(x - max(z)) for x in z]
        p.append([x / sum(e) for x in e])
        n.append(len(own))
    assert all(abs(getattr(r, f"p_{d}") - p[i][j]) < 1e-9 for i, r in enumerate(found) for j, d in enumerate("abc")) and [r.n_tokens for r in found] == n
    # minimise (b - A x)' M^-1 (b - A x) over x >= 0, M being the Gram matrix
    a = np.array(p).T * np.array(n)
    b = np.array([targets[d] for d in "abc"]) * sum(n)
    inverse = np.linalg.inv((a / np.array(n)) @ a.T)
    root = np.linalg.cholesky(inverse).T
    x = active_sets(root @ a, root @ b)
    loss = lambda y: float((b - a @ y) @ inverse @ (b - a @ y))
    mine = np.array([r.rate for r in found])
    assert mine.min() == 0.0 and -1e-9 < loss(mine) - loss(x) < 1e-3 * loss(np.ones(len(rows)))
    assert np.abs(a @ mine - a @ x).max() < 1e-2 * sum(n)


def test_mixing_meets_lopsided_targets(spark):
    """Targets far from what the rows hold are met in few steps."""
    docs = spark.createDataFrame([(i, "abc"[i % 3] + " " + "abc"[i * i % 3] + " " + "abc"[i // 7 % 3]) for i in range(90)], DOCS)
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "doc_id long, domain string")
    targets = {"a": 0.2, "b": 0.2, "c": 0.6}
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="the rates did not settle")
        rows = mixing.mixing_rates(docs, labels, targets, max_steps=60).collect()
    assert min(r.rate for r in rows) >= 0
    for d, share in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / sum(r.n_tokens for r in rows) - share) < 1e-5


def test_mixing_tells_what_did_not_settle(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b b a"), (3, "c")], DOCS)
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="did not settle"):
        mixing.mixing_rates(docs, labels, {"x": 3.0, "y": 0.0}, max_steps=1)


def test_mixing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "z"), (4, "long " * 60000)]
    docs = spark.createDataFrame([(a, b, "r") for a, b in rows], DOCS + ", Rate string")
    labels = spark.createDataFrame([], "doc_id long, domain string")
    mixed = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert mixed.columns == ["doc_id", "text", "Rate", "n_tokens", "rate_"] and mixed.count() == 6
    assert sorted(r.n_tokens for r in mixed.collect()) == [0, 0, 1, 2, 2, 60000]
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0}).isEmpty()


@pytest.mark.parametrize("k", range(1, 5))
def test_solve(k):
    m = [[1.0 / (i + j + 1) + (i == j) for j in range(k)] for i in range(k)]
    x = mixing.solve(m, [1.0] * k, 0.0)
    assert all(abs(sum(m[i][j] * x[j] for j in range(k)) - 1) < 1e-9 for i in range(k))
