"""Mixing to target weights by soft membership.

A softmax classifier, learned from the labelled table, gives every document its posterior over domains (good, poor,
toxic). With a document's tokens that makes expected domain totals, and projected gradient descent on weighted least
squares finds a rate in [0, max_rate] for each document whose expected domain totals match the targets. A rate is the
share of a document to take: thinning by a hash of the document keeps it with that probability, always the same ones.

    minimise  sum over domains d of (sum_i tokens_i p_id w_i - target_d)^2 / total_d,   w in [0, max_rate]

Steps are taken in the metric of the tokens (w_i moves by p_i . g, not by tokens_i p_i . g), so that rates depend on what
a document is and not on its length. The rate of a document is a fold of its posterior over the steps so far; so a round
is one pass that sums a number for each domain, and the driver holds only those steps.

The budget of tokens is the one at which the domain of the greatest weight is taken whole, however rare it is; of a domain that
has less than its share of that, all is taken.

The classifier is fitted on about SAMPLE_DOCS labelled documents of each domain, drawn by a hash of doc_id. Everything
else covers all documents.

Defined results: a null or empty text has no tokens, and the prior as its posterior. Labels with a null field are not
used; of labels that contradict each other the worst counts (toxic, then poor); of several texts with one labelled doc_id the
least is learned from; where nothing is labelled every document is `good`. Repeated rows get a row each with the same rate. Documents
without any tokens keep rate max_rate. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import WORD_BYTES, Workspace, mix, text_key, word_hashes

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.94, "poor": 0.04, "toxic": 0.02}
SAMPLE_DOCS = 2000
BUCKETS = 1 << 17
EPOCHS = 12
RATE = 0.5
DECAY = 1e-6
ROUNDS = 60
CLOSE = 1e-4
MAX_RATE = 1.0


def features(text: str | None) -> tuple[np.ndarray, int]:
    """(distinct feature buckets, words): the words, the pairs of signs between them, and the shape of the whole."""
    blob = (text or "").encode("utf-8", "surrogatepass")
    words, starts = word_hashes(blob.translate(WORD_BYTES))
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0
    raw = np.frombuffer(blob, np.uint8)
    sign = (raw < 128) & ~(((raw | 32) >= 97) & ((raw | 32) <= 122)) & ~((raw >= 48) & (raw <= 57)) & (raw != 32)
    at = np.flatnonzero(sign[1:] & sign[:-1])
    pairs = raw[at].astype(np.uint64) * np.uint64(256) + raw[at + 1]
    upper = (raw >= 65) & (raw <= 90)
    bins = [min(9, 10 * len(np.unique(words)) // (n + 1)), 10 + min(9, 10 * int(upper.sum()) // len(raw)), 20 + min(9, int(math.log2(n + 1))), 30 + min(9, 20 * int(sign.sum()) // len(raw))]
    every = np.concatenate([words, mix(pairs + np.uint64(1 << 40)), mix(np.asarray(bins, np.uint64) + np.uint64(1 << 50))])
    return np.unique((every >> np.uint64(20)).astype(np.int64) % BUCKETS), n


@dataclass
class Classifier:
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posterior(self, found: np.ndarray) -> np.ndarray:
        z = self.bias + (self.weights[found].sum(0) / math.sqrt(len(found)) if len(found) else 0)
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(rows: list[tuple[np.ndarray, int]], prior: np.ndarray, epochs: int = EPOCHS) -> Classifier:
    """Softmax regression by AdaGrad, one document at a time in a fixed shuffled order; rows are (features, domain)."""
    n_domain = len(prior)
    model = Classifier(np.zeros((BUCKETS, n_domain)), np.zeros(n_domain))
    if not rows:
        model.bias = np.log(np.asarray([1.0] + [1e-9] * (n_domain - 1)))
        return model
    square, square_b = np.full((BUCKETS, n_domain), 1e-3), np.full(n_domain, 1e-3)
    weight = prior / np.maximum(np.bincount([d for _, d in rows], minlength=n_domain) / len(rows), 1e-9)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, d = rows[k]
            p = model.posterior(f)
            p[d] -= 1
            p *= weight[d]
            square_b += p * p
            model.bias -= RATE * p / np.sqrt(square_b)
            if len(f):
                g = p[None, :] / math.sqrt(len(f)) + DECAY * model.weights[f]
                square[f] += g * g
                model.weights[f] -= RATE * g / np.sqrt(square[f])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Classifier:
    """The classifier of the labelled documents; the prior is that of all labelled doc_ids. What the driver gets is a set of
    at most BUCKETS features for each of about `sample` doc_ids a domain, however long or often repeated their texts are."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(domain).alias("domain"))
    sizes = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}
    if not sizes:
        return fit([], np.ones(len(DOMAINS)))
    rate = F.create_map(*(x for d, n in sizes.items() for x in (F.lit(d), F.lit(min(1.0, sample / n)))))
    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1_000_000)) / 1e6 < rate[F.col("domain")])
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")  # drawn: about 3 * sample rows
    rows = rows.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["found"] = [features(t)[0] for t in f["text"]]
            yield f[["doc_id", "domain", "found"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(run, f"doc_id {kind}, domain int, found array<bigint>").collect(), key=lambda r: r["doc_id"])
    prior = np.asarray([sizes.get(d, 0) for d in range(len(DOMAINS))], float)
    return fit([(np.asarray(r["found"], np.int64), r["domain"]) for r in got], prior / prior.sum())


def memberships(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b, n_tokens and posterior (an array in the order of DOMAINS) of every document."""
    model = spark.sparkContext.broadcast(train(docs, labels))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features(t) for t in f["text"]]
            f["n_tokens"] = [n for _, n in got]
            f["posterior"] = [model.value.posterior(x) for x, _ in got]
            yield f.drop(columns="text")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("i"), *text_key(), "text").mapInPandas(run, f"i {kind}, key_a bigint, key_b bigint, n_tokens bigint, posterior array<double>")


def fold_rates(posterior: np.ndarray, steps: np.ndarray, max_rate: float) -> np.ndarray:
    w = np.full(len(posterior), max_rate)
    for g in steps:
        w = np.clip(w - posterior @ g, 0, max_rate)
    return w


def expected(rows: DataFrame, steps: np.ndarray, max_rate: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Domain totals at the rates after some steps, and the sum of tokens * p p' (n x n)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, gram = np.zeros(n), np.zeros((n, n))
        for f in frames:
            if len(f):
                p, t = np.stack(f["posterior"].to_numpy()), f["n_tokens"].to_numpy(float)
                total += (p * (t * fold_rates(p, steps, max_rate))[:, None]).sum(0)
                gram += (p * t[:, None]).T @ p
        yield pd.DataFrame({"sums": [np.concatenate([total, gram.ravel()])]})

    parts = rows.select("n_tokens", "posterior").mapInPandas(run, "sums array<double>")
    k = n + n * n
    row = parts.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k))).first()
    got = np.asarray([row[i] or 0.0 for i in range(k)])
    return got[:n], got[n:].reshape(n, n)


def solve(rows: DataFrame, targets: dict[str, float], max_rate: float = MAX_RATE) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The steps of projected gradient descent, with the totals it began and ended with and those it aimed at."""
    n = len(DOMAINS)
    have, gram = expected(rows, np.zeros((0, n)), max_rate, n)
    weight = np.asarray([targets.get(d, 0.0) for d in DOMAINS])
    if have.sum() <= 0 or weight.sum() <= 0:
        return np.zeros((0, n)), {"have": have, "target": have, "got": have}
    budget = have[weight.argmax()] / weight.max()
    target, scale = np.minimum(weight * budget, have), np.maximum(have, 1.0)
    target[weight.argmax()] = have[weight.argmax()]  # not a rounding error less
    size = 1 / np.linalg.eigvalsh(gram / np.sqrt(scale[:, None] * scale[None, :])).max()
    steps, got = [], have
    for _ in range(ROUNDS):
        miss = (got - target) / scale
        if steps and np.abs(got - last).max() <= CLOSE * have.sum():  # noqa: F821
            break
        last = got
        steps.append(size * miss)
        got, _ = expected(rows, np.asarray(steps), max_rate, n)
    return np.asarray(steps), {"have": have, "target": target, "got": got}


def with_rates(rows: DataFrame, steps: np.ndarray, max_rate: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = np.stack(f["posterior"].to_numpy()) if len(f) else np.zeros((0, len(DOMAINS)))
            f["rate"] = np.where(f["n_tokens"] > 0, fold_rates(p, steps, max_rate), max_rate)
            yield f

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, rate double")


def mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """memberships() with rate and kept, the verdict of thinning."""
    ws = Workspace(spark, "mixing")
    rows = ws.write(memberships(spark, docs, labels), "memberships")
    steps, _ = solve(rows, TARGETS if targets is None else targets, max_rate)
    draw = F.pmod(F.xxhash64("i", "key_a", "key_b"), F.lit(1 << 30)) / float(1 << 30)
    return ws.write(with_rates(rows, steps, max_rate).withColumn("kept", draw < F.col("rate")), "rates")


def rates(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, n_tokens, its posterior for each domain, rate and kept."""
    rows = mixed(spark, docs, labels, **options)
    return rows.select(F.col("i").alias("doc_id"), "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "kept")


def thinned(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that thinning keeps, with docs' columns."""
    gone = mixed(spark, docs.select("doc_id", "text"), labels, **options).where(~F.col("kept")).select("i", "key_a", "key_b").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    a, b = text_key(text)
    keyed = docs.toDF(*names).select("*", a.alias("ka"), b.alias("kb"))
    on = doc_id.eqNullSafe(F.col("i")) & (F.col("ka") == F.col("key_a")) & (F.col("kb") == F.col("key_b"))
    return keyed.join(gone, on, "left_anti").select(*names).toDF(*docs.columns)
