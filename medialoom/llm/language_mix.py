"""Language identification as a mixture of languages.

Each learned language is a smoothed multinomial over hashed character trigrams of lower-cased words. The likelihood of
a word under a language is the product over its trigrams; a document is a mixture of languages, whose proportions
expectation-maximisation estimates from its words. The set of languages is the one of greatest likelihood less a
penalty for each language (BIC); lang_pred is its largest member.

Learning reads text and lang of a bounded sample of the labelled rows outside the held-out fold: about SAMPLE_DOCS
documents of each language, drawn by a hash of doc_id. Every label is learned; the broadcast model takes BUCKETS * 4 bytes
(256 KB) for each.

Defined results: a null text, one without letters, and any text where nothing could be learned is `und` with score 0.
score is the share of lang_pred in a mixture, else the posterior of the one language. A null doc_id is never learned
from and counts as held out. Repeated rows get a row each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import ARROW_ROWS

SAMPLE_DOCS = 1500
BUCKETS = 1 << 16
SMOOTH = 0.5
PENALTY = 3.0
ROUNDS = 12
#: Characters that are scored at once for up to MANY languages, fewer for more.
STEP = 1 << 19
MANY = 100
UNKNOWN = "und"
#: A pipeline keeps what has a language with at least this score.
MIN_SCORE = 0.3

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram of a word, first trigram of each word, first word of each text and the end).

    A word is a run of letters between two blanks; it has as many trigrams as letters.
    """
    lows = [t.lower() for t in texts]
    a = np.frombuffer(" ".join(["", *lows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([1] + [len(t) + 1 for t in lows])
    is_letter = letters()[a]
    a = np.where(is_letter, a, np.uint32(0))
    at = np.flatnonzero(is_letter)
    code = a[at - 1] * np.uint32(0x9E3779B1) ^ a[at] * np.uint32(0x85EBCA77) ^ a[at + 1] * np.uint32(0xC2B2AE3D)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~is_letter[at - 1])
    words = np.searchsorted(at[first], offsets)
    return (code >> np.uint32(16)).astype(np.int64) % BUCKETS, first, words


def pieces(texts: list[str], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about step characters."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= step:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log likelihoods


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model of (text, lang) rows."""
    counts: dict[str, np.ndarray] = {}
    for lang, found in counted(rows):
        counts[lang] = counts.get(lang, 0) + found
    return model_of(counts)


def counted(rows: list[tuple[str, str]]) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, times of each bucket) of the texts of each language."""
    for lang in sorted({lang for _, lang in rows}):
        texts = [t for t, x in rows if x == lang]
        found = np.zeros(BUCKETS, np.int64)
        for lo, hi in pieces(texts):
            found += np.bincount(trigrams(texts[lo:hi])[0], minlength=BUCKETS)
        yield lang, found


def model_of(counts: dict[str, np.ndarray]) -> Model:
    names = sorted(counts)
    table = np.zeros((BUCKETS, len(names)), np.float32)
    for k, name in enumerate(names):
        smooth = counts[name] + SMOOTH
        table[:, k] = np.log(smooth / smooth.sum())
    return Model(names, table)


def mixture(likely: np.ndarray) -> tuple[np.ndarray, float]:
    """EM on one document: proportions of the columns of a words x languages likelihood, and the log likelihood."""
    p = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(50):
        r = likely * p
        r /= r.sum(1, keepdims=True)
        new = r.mean(0)
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p, float(np.log((likely * p).sum(1)).sum())


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, str]]:
    """(language, score, languages with shares) of each text."""
    out, texts = [], [t if isinstance(t, str) else "" for t in texts]
    if not model.languages:
        return [(UNKNOWN, 0.0, "")] * len(texts)
    n_lang = len(model.languages)
    for lo, hi in pieces(texts, STEP * MANY // max(MANY, n_lang)):
        code, first, words = trigrams(texts[lo:hi])
        if not len(first):
            out += [(UNKNOWN, 0.0, "")] * (hi - lo)
            continue
        log = np.add.reduceat(model.table[code], first, axis=0).astype(np.float64)
        top = log.max(1, keepdims=True)
        likely = np.exp(log - top)
        count = np.diff(words)
        some = np.flatnonzero(count)
        starts = words[:-1][some]
        single = np.add.reduceat(log - top, starts, axis=0)
        doc = np.repeat(np.arange(len(some)), count[some])
        p = np.full((len(some), n_lang), 1 / n_lang)
        live = np.arange(len(some))
        part, owner, begins = likely, doc, starts - starts[0]
        for _ in range(ROUNDS):
            r = part * p[live][owner]
            r /= r.sum(1, keepdims=True)
            new = np.add.reduceat(r, begins, axis=0) / count[some[live], None]
            moved = np.abs(new - p[live]).max(1) > 1e-3
            p[live] = new
            if not moved.any():
                break
            keep = moved[owner]
            part, live = part[keep], live[moved]
            owner = np.repeat(np.arange(len(live)), count[some[live]])
            begins = np.concatenate([[0], np.cumsum(count[some[live]])[:-1]])
        mixed = np.add.reduceat(np.log((likely * p[doc]).sum(1)), starts)
        best = single.argmax(1)
        cost = PENALTY * np.log(count[some] + 1)
        got = [(UNKNOWN, 0.0, "")] * (hi - lo)
        for k, i in enumerate(some):
            alone = single[k, best[k]]
            if mixed[k] - alone <= cost[k]:
                share = 1 / np.exp(single[k] - alone).sum()
                name = model.languages[best[k]]
                got[i] = (name, float(min(1.0, share)), f"{name}:1.000")
                continue
            order = np.argsort(-p[k], kind="stable")
            chosen, shares, value = [best[k]], np.ones(1), alone
            for m in range(2, n_lang + 1):
                some_p, total = mixture(likely[words[i] : words[i + 1]][:, order[:m]])
                if total - (m - 1) * cost[k] <= value:
                    if m > 2:
                        break
                    continue
                chosen, shares, value = list(order[:m]), some_p, total - (m - 1) * cost[k]
            at = int(np.argmax(shares))
            by = sorted(zip(shares, chosen, strict=True), key=lambda x: (-x[0], x[1]))
            got[i] = (model.languages[chosen[at]], float(shares[at]), ",".join(f"{model.languages[c]}:{s:.3f}" for s, c in by))
        out += got
    return out


def fold():
    """0 for held-out rows; null where doc_id is."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Learns from about `sample` documents of each language outside the held-out fold. Executors count; what the driver gets
    is BUCKETS numbers a language, however long the texts are."""
    rows = docs.select("doc_id", "text", "lang").where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    rate = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) / 1e6
    kept = rows.where(drawn < F.coalesce(rate[F.col("lang")], F.lit(0.0))).select("text", "lang")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, found in counted(list(zip(f["text"], f["lang"], strict=True))):
                total[lang] = total.get(lang, 0) + found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": found[at]})

    sums = kept.mapInPandas(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    every = sums.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))  # BUCKETS pairs at most
    counts = {}
    for r in every.toLocalIterator():
        counts[r["lang"]] = np.zeros(BUCKETS, np.int64)
        counts[r["lang"]][r["at"]] = r["n"]
    for r in sizes:  # languages whose documents have no letters
        counts.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))
    return model_of(counts)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id alone by default) with lang_pred, score and lang_mix."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    shared = spark.sparkContext.broadcast(train(docs) if model is None else model)
    keep = ["doc_id"] if keep is None else keep
    rest = [c for c in keep if c != "text"]
    names = [f"c{i}" for i in range(len(rest))]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest), "text").toDF(*names, "text")
    with_text = "text" in keep

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = predict(shared.value, f["text"].tolist())
            f["lang_pred"], f["score"], f["lang_mix"] = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            yield f if with_text else f.drop(columns="text")

    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if with_text or f.name != "text")
    rows = rows.mapInPandas(run, f"{carried}lang_pred string, score double, lang_mix string")
    back = dict(zip(rest, names, strict=True)) | {"text": "text"}
    return rows.select(*(F.col(back[c]).alias(c) for c in keep), "lang_pred", "score", "lang_mix")


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, lang_mix."""
    rows = identify(spark, docs)
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "lang_mix")


def with_language(spark: SparkSession, docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that have a language, with docs' columns."""
    rows = identify(spark, docs, keep=docs.columns)
    rows = rows.toDF(*(f"c{i}" for i in range(len(docs.columns))), "lang_pred", "score", "lang_mix").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
