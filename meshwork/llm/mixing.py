"""Mixing sources to target weights, with soft membership, in DataFrame operations only.

A naive Bayes classifier, fitted on a bounded sample of a labelled table, gives every document a posterior over the
domains. Distributed projected-gradient least squares then finds nonnegative document rates x such that the expected tokens of
each domain, sum x_i n_i p_id, meet the targets. Only sums over all documents, one number for each domain (or pair of domains), come to the driver.

The gradient is taken in the metric in which documents weigh as their tokens, and residuals are measured by the inverse of the
domains' Gram matrix M = sum n_i p_i p_i'. There the step 1 is the inverse of the Lipschitz constant, so one step solves
a problem whose rates stay positive. The update of a document, x_i <- max(0, y_i + p_i . v), needs nothing but its own posterior
and the domains' vector v. Steps start from y, the rates carried on along the last step with Nesterov's weights, so
the loss falls with the square of the number of steps; that is a pass over the rates for each, and few are needed.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import Workspace, fresh, words_native

#: Steps between two tables of rates written to the shared folder.
STEPS_BETWEEN = 5


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("bucket")


def fit_domains(texts: DataFrame, labels: DataFrame, domains: list[str], buckets: int, max_labelled: int, smoothing: float) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...) log-likelihoods of hashed words by domain, and the domains' log priors.

    labels: (doc_id, domain). The max_labelled rows whose ids hash lowest are used, so that side has a fixed bound.
    """
    known = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = texts.join(F.broadcast(chosen), "doc_id")
    words = sample.select("domain", F.explode(words_native(F.col("text"))).alias("word"))
    counts = words.groupBy(_bucket(buckets)).agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)))
    sizes = {r[0]: r[1] for r in chosen.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1.0) / (n + len(domains))) for d in domains]
    every = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    totals = every.agg(*(F.sum(f"c{i}") for i in range(len(domains)))).first()
    return every.select("bucket", *(F.log((F.col(f"c{i}") + smoothing) / (t + smoothing * buckets)).alias(f"w{i}") for i, t in enumerate(totals))), priors


def posteriors(texts: DataFrame, model: DataFrame, priors: list[float], buckets: int) -> DataFrame:
    """(row, doc_id, sig, n, p0, p1, ...) of every row; n counts words. A text without words has the priors.

    The evidence of n words is weighed as that of sqrt(n), since words that depend on each other tell less.
    """
    k = len(priors)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("sig"), words_native(F.col("text")).alias("words"))
    met = rows.select("row", "doc_id", "sig", F.explode_outer("words").alias("word")).withColumn("bucket", F.when(F.col("word").isNotNull(), _bucket(buckets))).join(F.broadcast(model), "bucket", "left")
    sums = met.groupBy("row", "doc_id", "sig").agg(F.count("word").alias("n"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)))
    logit = sums.select("row", "doc_id", "sig", "n", *((F.lit(priors[i]) + F.col(f"s{i}") / F.sqrt(F.greatest("n", F.lit(1)))).alias(f"z{i}") for i in range(k)))
    top = F.greatest(*(F.col(f"z{i}") for i in range(k))) if k > 1 else F.col("z0")
    raised = logit.select("row", "doc_id", "sig", "n", *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(k)))
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return raised.select("row", "doc_id", "sig", "n", *((F.col(f"e{i}") / total).alias(f"p{i}") for i in range(k)))


def solve(m: list[list[float]], r: list[float], ridge: float) -> list[float]:
    """(m + ridge * trace/k * I)^-1 r, by elimination with pivots; m is as small as the number of domains."""
    k = len(r)
    lift = ridge * (sum(m[i][i] for i in range(k)) / k or 1.0)
    rows = [[*(m[i][j] + lift * (i == j) for j in range(k)), r[i]] for i in range(k)]
    for i in range(k):
        pivot = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for j in range(k):
            if j != i and rows[j][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", tokens: float | None = None, buckets: int = 1 << 14, max_labelled: int = 20_000, smoothing: float = 0.5, tolerance: float = 1e-6, max_steps: int = 200, ridge: float = 1e-9, work: Workspace | None = None) -> DataFrame:
    """(doc_id, sig, n_tokens, rate, p_<domain>...) for every row of docs.

    targets: the share of each domain, which need not add up to 1; of tokens in all, by default as many as docs has.
    labels: (doc_id, domain); domains without a target, and nulls, are left out. rate is how often a document
    is to be drawn on average, 0 or more, 1 where nothing has to change. Where the targets cannot be met the rates
    are those of the least squares. Steps go on until the gap, or its change, is below tolerance; after max_steps a warning tells the gap
    that is left. A null text, or one without words, has 0 tokens and the priors as posterior. Repeated rows
    get equal rates. sig is the xxhash64 of the text, by which a rate finds its row where doc_ids repeat. An empty table gives an empty
    result; further columns of docs are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "mixing")
    domains = sorted(targets)
    k = len(domains)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model, priors = fit_domains(texts, labels, domains, buckets, max_labelled, smoothing)
    model = work.put("model", model)
    state = work.put("state0", posteriors(texts, model, priors, buckets).withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)))
    grams = [(i, j) for i in range(k) for j in range(i, k)]
    first = state.agg(F.coalesce(F.sum("n"), F.lit(0)), *(F.coalesce(F.sum(F.col("n") * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)) for i, j in grams)).first()
    gram = [[0.0] * k for _ in range(k)]
    for (i, j), value in zip(grams, first[1:], strict=True):
        gram[i][j] = gram[j][i] = value
    budget = first[0] if tokens is None else tokens
    wanted = [targets[d] * budget for d in domains]
    x, last, weight = F.col("x"), "state0", 1.0
    for step in range(1, max_steps + 1):
        sums = state.agg(*(F.coalesce(F.sum(F.col(at) * F.col("n") * F.col(f"p{i}")), F.lit(0.0)) for at in "xy" for i in range(k))).first()
        gap, ahead = ([a - b for a, b in zip(wanted, had, strict=True)] for had in (sums[:k], sums[k:]))
        if max(map(abs, gap)) <= tolerance * max(1.0, budget):
            break
        v = solve(gram, ahead, ridge)
        moved = sum((F.col(f"p{i}") * F.lit(v[i]) for i in range(1, k)), F.col("p0") * F.lit(v[0]))
        if max(map(abs, v)) <= tolerance * 0.1:
            break
        had_weight, weight = weight, (1 + math.sqrt(1 + 4 * weight * weight)) / 2
        state = state.withColumn("next", F.greatest(F.lit(0.0), F.col("y") + moved))
        state = state.withColumn("y", F.col("next") + F.lit((had_weight - 1) / weight) * (F.col("next") - x)).drop("x").withColumnRenamed("next", "x")
        if step == max_steps:
            warnings.warn(f"the rates did not settle in {max_steps} steps; the largest gap is {max(map(abs, gap)):.3g} of {budget:.3g} tokens", stacklevel=2)
        if step % STEPS_BETWEEN == 0:
            state = work.put(f"state{step}", state)
            work.drop(last)
            last = f"state{step}"
    return state.select("doc_id", "sig", F.col("n").alias("n_tokens"), x.alias("rate"), *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all rows and columns, with two columns more: n_tokens and rate. Defined as in mixing_rates().

    A clashing name of docs' columns is kept, and the new column gets an underscore.
    """
    of, sig, n, rate = fresh(docs, "of_doc", "of_sig", "n_tokens", "rate")
    rates = mixing_rates(docs, labels, targets, id_col, text_col, **options)
    rates = rates.groupBy(F.col("doc_id").alias(of), F.col("sig").alias(sig)).agg(F.first("n_tokens").alias(n), F.first("rate").alias(rate))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text_col)) == F.col(sig))
    return docs.join(rates, same, "left").select(*(docs[c] for c in docs.columns), n, rate)
