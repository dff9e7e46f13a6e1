"""Toxicity: a counterfactual-regularised linear classifier.

The model is a sparse logistic regression over the presence of lower-cased words and of their prefixes, of which those that tell most
of the labels are chosen. It is fitted on a bounded sample of labelled texts. In every labelled sentence that mentions a group of people the terms are
swapped, each for the term of another group in the same language, kind and number, and for a mention of nobody, which has no features; a
change of the sentence's score is penalised. The first swap makes groups equal, the second holds them at nothing: without it a group that
labels blame would drag those along that no labelled text mentions. The terms themselves are such sentences too, so those that no labelled text mentions are no accident of others' prefixes.
Mentioning a group neutrally therefore moves a score by next to nothing, whatever the labels' accidents. Scores of all texts are
computed in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, lean, portions

#: Terms for groups of people, by language, kind and number.
IDENTITY_TERMS = {
    ("en", "belief", "one"): ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"],
    ("en", "belief", "many"): ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"],
    ("en", "origin", "one"): ["african", "american", "arab", "asian", "chinese", "european", "indian", "latino", "mexican"],
    ("en", "origin", "many"): ["africans", "americans", "arabs", "asians", "europeans", "indians", "latinos", "mexicans"],
    ("en", "arrival", "one"): ["immigrant", "migrant", "refugee"],
    ("en", "arrival", "many"): ["immigrants", "migrants", "refugees"],
    ("en", "colour", "one"): ["black", "white", "brown"],
    ("en", "colour", "many"): ["blacks", "whites"],
    ("en", "adult", "one"): ["woman", "man"],
    ("en", "adult", "many"): ["women", "men"],
    ("en", "child", "one"): ["girl", "boy"],
    ("en", "child", "many"): ["girls", "boys"],
    ("en", "gender", "one"): ["female", "male", "transgender", "nonbinary"],
    ("en", "gender", "many"): ["females", "males"],
    ("en", "orientation", "one"): ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    ("en", "orientation", "many"): ["gays", "lesbians", "bisexuals", "heterosexuals", "homosexuals"],
    ("en", "ability", "one"): ["disabled", "deaf", "blind", "autistic"],
    ("en", "age", "one"): ["young", "old", "elderly"],
    ("en", "age", "many"): ["teenagers", "pensioners"],
    ("de", "belief", "many"): ["muslime", "juden", "christen", "buddhisten", "atheisten"],
    ("de", "belief", "one"): ["moslem", "jude", "christ", "atheist"],
    ("de", "origin", "many"): ["türken", "araber", "afrikaner", "polen", "syrer", "flüchtlinge"],
    ("de", "adult", "one"): ["frau", "mann"],
    ("de", "adult", "many"): ["frauen", "männer"],
    ("fr", "belief", "one"): ["musulman", "juif", "chrétien"],
    ("fr", "belief", "many"): ["musulmans", "juifs", "chrétiens"],
    ("fr", "origin", "many"): ["arabes", "africains", "asiatiques", "réfugiés"],
    ("fr", "colour", "many"): ["noirs", "blancs"],
    ("fr", "adult", "one"): ["femme", "homme"],
    ("fr", "adult", "many"): ["femmes", "hommes"],
    ("es", "belief", "one"): ["musulmán", "judío", "cristiano"],
    ("es", "belief", "many"): ["musulmanes", "judíos", "cristianos"],
    ("es", "origin", "many"): ["inmigrantes", "refugiados", "africanos", "gitanos"],
    ("es", "adult", "one"): ["mujer", "hombre"],
    ("es", "adult", "many"): ["mujeres", "hombres"],
}
#: Of each term its list; a term in lists of two languages has the first.
LIST_OF: dict[str, list[str]] = {}
for _terms in IDENTITY_TERMS.values():
    for _term in _terms:
        LIST_OF.setdefault(_term, _terms)
#: The end of a sentence.
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
PREFIXES = range(3, 9)
#: Entries that a worker keeps of the words it has met.
CACHE = 1 << 17
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
SCORE_TYPES = "doc_id long, held_out boolean, score double, predicted int"


def plain_word(token: str) -> str:
    """A token without signs and digits at its ends; the token itself where nothing else is left."""
    return EDGE.sub("", token) or token


def plain_words(text: str, known: dict[str, str]) -> set[str]:
    """The distinct words of a text, lower-cased. known keeps what was worked out before, within bounds."""
    out = set()
    for token in set(text.lower().split()):
        word = known.get(token)
        if word is None:
            if len(known) >= CACHE:
                known.clear()
            word = known[token] = plain_word(token)
        out.add(word)
    return out


def features(word: str) -> list[int]:
    """A word's features, hashed: itself, and its proper prefixes."""
    out = [xxhash.xxh3_64_intdigest("=" + word) >> 1]
    out += [xxhash.xxh3_64_intdigest(word[:n]) >> 1 for n in PREFIXES if len(word) > n]
    return out


@dataclass
class Model:
    """bias and the nonzero weights, a bounded number of them. Unless fitted it knows the share of labels alone."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    fitted: bool = True

    def score(self, words: Iterable[str], known: dict[str, tuple[int, ...]]) -> float:
        """The score of a text's distinct words or tokens, lower-cased. known keeps of each its features in the model, within bounds, and no further strings."""
        hits: set[int] = set()
        for word in words:
            own = known.get(word)
            if own is None:
                if len(known) >= CACHE:
                    known.clear()
                own = known[word] = tuple(f for f in features(plain_word(word)) if f in self.weights)
            if own:
                hits.update(own)
        z = self.bias + math.fsum(self.weights[f] for f in hits)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def swapped(words: set[str]) -> list[set[str]]:
    """The words with every identity term replaced by another group's term of its language, kind and number, and with every one left out.

    None where there are no terms. Of the other groups the next one that is not mentioned is taken; two terms of one list get different ones.
    """
    mine = sorted(w for w in words if w in LIST_OF)
    if not mine:
        return []
    rest = words.difference(mine)
    other, taken = set(rest), set(mine)
    for term in mine:
        groups = LIST_OF[term]
        at = groups.index(term)
        free = [t for t in groups[at + 1 :] + groups[:at] if t not in taken]
        # where all groups are mentioned the next one is taken all the same
        to = free[0] if free else groups[(at + 1) % len(groups)]
        taken.add(to)
        other.add(to)
    return [other, rest]


def changes(words: set[str]) -> list[tuple[list[int], list[int]]]:
    """Of each swap in a sentence of these words the features that come and those that go."""
    mine = {f for w in words for f in features(w)}
    out = []
    for other in swapped(words):
        then = {f for w in other for f in features(w)}
        out.append((sorted(then - mine), sorted(mine - then)))
    return [c for c in out if c[0] or c[1]]


class Rows:
    """Sparse rows: ends of the rows, columns, and values (1 where there are none)."""

    def __init__(self, ends: np.ndarray, columns: np.ndarray, width: int, values: np.ndarray | None = None):
        self.n, self.width, self.columns, self.values = len(ends) - 1, width, columns, values
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))

    def dot(self, w: np.ndarray) -> np.ndarray:
        x = w[self.columns]
        return np.bincount(self.row, x if self.values is None else x * self.values, self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        x = r[self.row]
        return np.bincount(self.columns, x if self.values is None else x * self.values, self.width)


@dataclass
class Sample:
    """Labelled texts by their features' places in ids: row i has found[ends[i]:ends[i + 1]]. swaps: what comes, what goes, and in how many sentences."""

    ids: np.ndarray
    toxic: np.ndarray
    ends: np.ndarray
    found: np.ndarray
    swaps: list[tuple[list[int], list[int], int]]


class Objective:
    """loss(w, c): mean logistic loss + fairness * mean squared change of score under swaps. The L1 term is apart."""

    def __init__(self, sample: Sample, fairness: float):
        self.y, self.fairness = sample.toxic.astype(np.float64), fairness
        self.n, self.width = len(self.y), len(sample.ids)
        self.x = Rows(sample.ends, sample.found, self.width)
        lengths = [len(p) + len(m) for p, m, _ in sample.swaps]
        values = [v for p, m, _ in sample.swaps for v in [1.0] * len(p) + [-1.0] * len(m)]
        self.d = Rows(np.cumsum([0, *lengths]), np.array([f for p, m, _ in sample.swaps for f in p + m], np.int32), self.width, np.array(values, np.float64))
        counts = np.array([n for *_, n in sample.swaps], np.float64)
        self.share = counts / (counts.sum() or 1.0)

    def loss(self, w: np.ndarray, c: float) -> float:
        z = self.x.dot(w) + c
        return float(np.mean(np.logaddexp(0, z) - self.y * z) + self.fairness * np.sum(self.share * self.d.dot(w) ** 2))

    def gradient(self, w: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        gap = 1 / (1 + np.exp(-np.clip(self.x.dot(w) + c, -60, 60))) - self.y
        return self.x.back(gap) / self.n + 2 * self.fairness * self.d.back(self.share * self.d.dot(w)), float(np.mean(gap))

    def step(self) -> float:
        """A step below the inverse of the gradient's Lipschitz constant, by power iteration over both quadratic forms."""
        v, top = np.ones(self.width) / math.sqrt(self.width), 1.0
        for _ in range(20):
            v = self.x.back(self.x.dot(v)) / (4 * self.n) + 2 * self.fairness * self.d.back(self.share * self.d.dot(v))
            top = float(np.linalg.norm(v)) or 1.0
            v /= top
        return 1 / (1.2 * top + 0.3)


def fit(sample: Sample, l1: float = 1e-4, fairness: float = 1.0, steps: int = 300) -> Model:
    """Fit by accelerated proximal gradient: mean logistic loss, L1, and fairness * mean squared change under swaps."""
    n, n_toxic = len(sample.toxic), int(sample.toxic.sum())
    prior = math.log((n_toxic + 0.5) / (n - n_toxic + 1.0))
    if not 0 < n_toxic < n:
        return Model(prior, fitted=False)
    goal = Objective(sample, fairness)
    step = goal.step()
    w, c, w_old, c_old, t = np.zeros(goal.width), prior, np.zeros(goal.width), prior, 1.0
    for _ in range(steps):
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = (t - 1) / t_new
        u, bias = w + ahead * (w - w_old), c + ahead * (c - c_old)
        down, down_c = goal.gradient(u, bias)
        w_old, c_old, t = w, c, t_new
        w = u - step * down
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        c = bias - step * down_c
    return Model(float(c), {int(sample.ids[i]): float(w[i]) for i in np.flatnonzero(w)})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, found, swaps): a text's features, and the changes of each swap in each of its sentences."""
    known: dict[str, str] = {}
    change = pa.struct([("plus", pa.list_(pa.int64())), ("minus", pa.list_(pa.int64()))])
    for data in portions(batches):
        found, swaps = [], []
        for text in data.column(2).to_pylist():
            found.append(sorted({f for w in plain_words(text or "", known) for f in features(w)}))
            sentences = [plain_words(s, known) for s in SENTENCE.split(text)] if text and not LIST_OF.keys().isdisjoint(plain_words(text, known)) else []
            swaps.append([{"plus": p, "minus": m} for words in sentences for p, m in changes(words)])
        yield pa.RecordBatch.from_arrays([data.column(0), data.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(swaps, pa.list_(change))], names=["doc_id", "toxic", "found", "swaps"])


def _placed(ids: np.ndarray):
    """Features as places in the sorted ids; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            column = data.column(2)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
            known = ids[at] == values
            total = np.concatenate([[0], np.cumsum(known)])[ends]
            places = at[ends[0] : ends[-1]][known[ends[0] : ends[-1]]]
            found = pa.ListArray.from_arrays(pa.array((total - total[0]).astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([data.column(0), data.column(1), found], names=["doc_id", "toxic", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8_000, max_features: int = 20_000, lexicon: bool = True, **options) -> Model:
    """A model from at most max_labelled labelled rows, those whose ids hash lowest, and the max_features features that tell most.

    labels: doc_id and toxic. Rows with a null in either, or a toxic other than 0 and 1, are left out; of several
    labels of a doc_id the largest counts, and of rows that repeat a doc_id the one with the lowest text. The sample
    is bounded, so the places of its chosen features may go to the driver; texts do not. max_features bounds the model, not the data: a feature
    that one labelled text alone has tells nothing of others. lexicon adds a swap of each term on its own.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    sample = work.put("sample", rows.mapInArrow(_hashed, "doc_id long, toxic int, found array<long>, swaps array<struct<plus: array<long>, minus: array<long>>>"))
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # the features whose presence tells most of the label, by a smoothed log-likelihood ratio
    seen = sample.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).where("n >= 2")
    a, b, a0, b0 = F.col("n1") + 0.5, F.col("n") - F.col("n1") + 0.5, n_toxic + 1.0, n - n_toxic + 1.0
    gain = F.abs(a * F.log(a / (a + b) * ((a0 + b0) / a0)) + b * F.log(b / (a + b) * ((a0 + b0) / b0)))
    best = seen.select("f", F.round(gain, 9).alias("gain")).orderBy(F.desc("gain"), "f").limit(max_features)
    ids = np.unique(np.array([r.f for r in best.collect()] + [f for t in LIST_OF for f in features(t)], np.int64))
    table = sample.select("doc_id", "toxic", "found").mapInArrow(_placed(ids), "doc_id long, toxic int, found array<int>").toArrow()
    table = table.take(np.argsort(table.column("doc_id").to_numpy(), kind="stable")).combine_chunks()
    found = table.column("found").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    ends = found.offsets.to_numpy().astype(np.int64)
    # equal swaps of many sentences are one row, so there are as many as pairs of terms in the same surroundings
    counted = sample.select(F.inline("swaps")).groupBy("plus", "minus").agg(F.count("*").alias("n"))
    swaps = sorted((list(r.plus), list(r.minus), r.n) for r in counted.collect())
    if lexicon:
        swaps += [(p, m, 1) for t in LIST_OF for p, m in changes({t})]
    work.drop("sample")
    place = {int(f): i for i, f in enumerate(ids)}
    swaps = [([place[f] for f in p if f in place], [place[f] for f in m if f in place], n) for p, m, n in swaps]
    return fit(Sample(ids, table.column("toxic").to_numpy(), ends - ends[0], found.values.to_numpy()[ends[0] : ends[-1]], swaps), **options)


def held_out(id_col: str):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for data in portions(batches):
            score = [model.score(set((t or "").lower().split()), known) for t in data.column(2).to_pylist()]
            predicted = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays([data.column(0), data.column(1), pa.array(score, pa.float64()), pa.array(predicted, pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, in one pass.

    Learns from the labels of rows that are not held out. score is the probability of label 1, from the text alone;
    a null or empty text gets the score of no words. Without labels of both kinds the score is the (smoothed) share
    of toxic labels for every text, a third without any. Repeated rows are scored alike; an empty table gives an empty result; further
    columns are not read.
    """
    lean(docs.sparkSession)
    model = train(docs, labels.where(~held_out("doc_id")), id_col, text_col, **options)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(_scores(model), SCORE_TYPES)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is below 0.5; defined as in toxicity().

    Without labels of both kinds nothing tells toxic texts from others, and all rows stay.
    """
    lean(docs.sparkSession)
    model = train(docs, labels.where(~held_out("doc_id")), id_col, text_col, **options)
    if not model.fitted:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for data in portions(batches):
            yield data.filter(pa.array([model.score(set((t or "").lower().split()), known) < 0.5 for t in data.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
