"""Benchmark decontamination by suffix arrays of the training texts.

Documents come in shards of about SHARD_BYTES. The words of a shard are numbered by the benchmark's vocabulary (0: any
other word, and the end of a document); its suffix array orders the positions of vocabulary words by what follows them,
by prefix doubling, to the depth of the longest benchmark item. Every suffix of every item is then binary-searched in
every shard: its neighbours there give its longest verbatim match, and where that covers a window, the window's range in
the array gives all of its locations.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. Words are runs of
0-9, a-z and all beyond ASCII after A-Z became a-z.

The benchmark goes to the tasks in blocks of at most about BLOCK_BYTES of text, one block after the other over all
documents; the spans found so far travel with the rows in between, through the shared folder.

Defined results: a null or wordless document has no words and is not contaminated; null and wordless items match
nothing; repeated items count each, a null item_id is written as an empty string; repeated documents get a row each.
Extra columns are not read, whatever their names. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import Workspace, batches, word_hashes

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: So many item_ids, whatever their texts are, are dealt by their hashes beyond that.
IDS = 100_000
SHARD_BYTES = 1 << 22
QUERIES = 4096
#: A document is contaminated if its words hit are at least one in so many.
SHARE = 20


class Block:
    """Some benchmark items: their words by number, every suffix as a row, and the windows among the suffixes."""

    def __init__(self, items: list[tuple[list[str], str]], window: int = WINDOW):
        """items: the item_ids of a text, and the text."""
        found = []
        for _, data, offsets in batches([t for _, t in items], lower=False):
            h, s = word_hashes(data)
            cuts = np.searchsorted(s, offsets)
            found += [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kept = [(i, w) for (i, _), w in zip(items, found, strict=True) if len(w)]
        self.items = [i for i, _ in kept]
        words = [w for _, w in kept]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.depth = max(map(len, words), default=0)
        self.words = [(np.searchsorted(self.vocabulary, w) + 1).astype(np.int32) for w in words]
        lens = np.asarray([len(w) for w in words], np.int64)
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int32)])
        self.item = np.repeat(np.arange(len(words)), lens)
        start = np.repeat(np.cumsum(lens) - lens, lens)
        self.left = np.repeat(lens, lens) - (np.arange(len(self.flat)) - start)
        span = np.minimum(window, np.repeat(lens, lens))
        self.window = np.where(self.left >= span, span, 0)

    def suffixes(self, lo: int, hi: int) -> np.ndarray:
        """Rows of the words of suffixes lo to hi, filled up with -1."""
        width = int(self.left[lo:hi].max())
        at = np.arange(lo, hi)[:, None] + np.arange(width)[None, :]
        return np.where(np.arange(width)[None, :] < self.left[lo:hi, None], self.flat[np.minimum(at, len(self.flat) - 1)], -1)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The positions of s that are not 0, ordered by the `depth` numbers from there on."""
    at = np.flatnonzero(s)
    rank = np.zeros(len(s) + depth + 1, np.int64)
    rank[: len(s)] = s
    length, order = 1, np.argsort(rank[at], kind="stable")
    while length < depth:
        key = rank[at] * np.int64(len(s) + int(s.max(initial=0)) + 2) + rank[at + length]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        rank[at[order]] = new
        length *= 2
        if len(new) and new[-1] == len(at):
            break
    return at[order]


def compare(s: np.ndarray, at: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words against s at given places: the common length, and whether s sorts before the row.

    Only the first words of most rows need a look, so the comparison widens for those that still agree.
    """
    common, less = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    live, done = np.arange(len(at)), 0
    while len(live):
        width = 4 if not done else 16
        upto = min(done + width, rows.shape[1])
        if upto == done:
            break
        a = s[at[live, None] + np.arange(done, upto)[None, :]]
        b = rows[live, done:upto]
        differ = (a != b) | (np.arange(done, upto)[None, :] >= lengths[live, None])
        first = np.where(differ.any(1), differ.argmax(1), upto - done)
        common[live] = done + first
        over = first < upto - done
        k = np.minimum(first, upto - done - 1)
        inside = over & (done + first < lengths[live])
        less[live] = np.where(inside, a[np.arange(len(live)), k] < b[np.arange(len(live)), k], False)
        live, done = live[~over], upto
    return common, less


def lower_bound(s: np.ndarray, sa: np.ndarray, rows: np.ndarray, lengths: np.ndarray, past: bool = False) -> np.ndarray:
    """For each row the first place in sa that doesn't sort before it; past: the first place after all that begin with it."""
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(sa), np.int64)
    while (open_ := lo < hi).any():
        q = np.flatnonzero(open_)
        mid = (lo[q] + hi[q]) // 2
        common, less = compare(s, sa[mid], rows[q], lengths[q])
        before = less | (past & (common >= lengths[q]))
        lo[q] = np.where(before, mid + 1, lo[q])
        hi[q] = np.where(before, hi[q], mid)
    return lo


def search(block: Block, words: np.ndarray, cuts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each document of a shard: its hit spans (starts and ends, one after the other), the items that hit, and its longest match."""
    n = len(cuts) - 1
    number = np.searchsorted(block.vocabulary, words)
    number = np.where(block.vocabulary[np.minimum(number, len(block.vocabulary) - 1)] == words, number + 1, 0).astype(np.int32)
    doc = np.repeat(np.arange(n), np.diff(cuts))
    s = np.zeros(len(words) + n + block.depth + 2, np.int32)
    place = np.arange(len(words)) + doc
    s[place] = number
    sa = suffix_array(s[: len(words) + n], block.depth)
    longest = np.zeros(n, np.int64)
    owner = np.zeros(len(s), np.int64)
    owner[place] = doc
    starts, ends, docs, items = ([np.zeros(0, np.int64)] for _ in range(4))
    for lo in range(0, len(block.flat) if len(sa) else 0, QUERIES):
        hi = min(lo + QUERIES, len(block.flat))
        rows, left, window = block.suffixes(lo, hi), block.left[lo:hi], block.window[lo:hi]
        p = lower_bound(s, sa, rows, left)
        best = np.zeros(hi - lo, np.int64)
        for near in (p - 1, p):
            ok = np.flatnonzero((near >= 0) & (near < len(sa)))
            common, _ = compare(s, sa[near[ok]], rows[ok], left[ok])
            best[ok] = np.maximum(best[ok], common)
        q = np.flatnonzero((window > 0) & (best >= window))
        if not len(q):
            continue
        first = lower_bound(s, sa, rows[q], window[q])
        last = lower_bound(s, sa, rows[q], window[q], past=True)
        many = last - first
        every = np.repeat(q, many)
        at = sa[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        for k in range(0, len(at), 65536):
            e, x = every[k : k + 65536], at[k : k + 65536]
            common, _ = compare(s, x, rows[e], left[e])
            np.maximum.at(longest, owner[x], common)
        starts.append(at)
        ends.append(at + window[every])
        docs.append(owner[at])
        items.append(block.item[lo + every])
    starts, ends, docs, items = map(np.concatenate, (starts, ends, docs, items))
    order = np.lexsort((starts, docs))
    starts, ends, docs, items = starts[order], ends[order], docs[order], items[order]
    bounds = np.searchsorted(docs, np.arange(n + 1))
    spans, found = [], []
    for d in range(n):
        a, b = bounds[d], bounds[d + 1]
        spans.append(np.stack([starts[a:b] - cuts[d] - d, ends[a:b] - cuts[d] - d], 1))
        found.append(np.unique(items[a:b]))
    return spans, found, longest


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that meet or overlap made one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def scan(block):
    """mapInPandas over (text, spans, items, longest, ...): adds what one block of the benchmark finds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block.value
        for f in frames:
            spans, items, longest, n_words = [], [], [], []
            texts, at = f["text"].tolist(), 0
            while at < len(texts):
                held, words = 0, []
                to = at
                while to < len(texts) and (held < SHARD_BYTES or to == at):
                    held += len(texts[to] or "")
                    to += 1
                for _, data, offsets in batches(texts[at:to], lower=False):
                    h, s = word_hashes(data)
                    cuts = np.searchsorted(s, offsets)
                    words += [h[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                got = search(b, np.concatenate(words), cuts) if len(b.flat) else ([np.zeros((0, 2), np.int64)] * len(words), [[]] * len(words), np.zeros(len(words), np.int64))
                n_words += [len(w) for w in words]
                spans += got[0]
                items += [[name for i in x for name in b.items[i]] for x in got[1]]
                longest += got[2].tolist()
                at = to
            f["spans"] = [joined(np.concatenate([np.asarray(x, np.int64).reshape(-1, 2), y])).ravel() for x, y in zip(f["spans"], spans, strict=True)]
            f["items"] = [[*x, *y] for x, y in zip(f["items"], items, strict=True)]
            f["longest"] = np.maximum(f["longest"].to_numpy(), longest)
            f["n_words"] = n_words
            yield f

    return run


def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["n_hit"] = [int(np.sum(x[1::2]) - np.sum(x[::2])) for x in f["spans"]]
        f["n_items"] = [len(x) for x in f["items"]]
        f["items_sha256"] = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in f["items"]]
        yield f.drop(columns="items")


def blocks_of(ws: Workspace, benchmark: DataFrame) -> Iterator[list[tuple[list[str], str]]]:
    """The benchmark's different texts, each with its item_ids, in lists of about BLOCK_BYTES: a hash deals a text to a block, so
    none is cut. Ids are dealt too where there are more than IDS of them, so a text that is repeated without end comes
    several times, with some of its ids each."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull())
    parts = max(1, math.ceil(rows.count() / IDS))
    deal = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    texts = ws.write(rows.groupBy("text", deal.alias("part")).agg(F.collect_list("item_id").alias("ids")), "benchmark")
    size = F.octet_length("text") + F.octet_length(F.array_join("ids", ",")) + 8
    total = texts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        yield [(r["ids"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("text", "part"), F.lit(n)) == k).collect()]


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id alone by default) with n_words, n_hit, n_items, items_sha256, longest (words of the
    longest verbatim match that covers a window) and spans (starts and ends of the words hit, one after the other)."""
    ws = Workspace(spark, "decontaminate")
    keep = ["doc_id"] if keep is None else keep
    rest = [c for c in keep if c != "text"]
    names = [f"c{i}" for i in range(len(rest))]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest), "text").toDF(*names, "text")
    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields)
    none = {"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>"), "longest": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long")}
    rows = rows.withColumns(none)
    for k, items in enumerate(blocks_of(ws, benchmark)):
        rows = ws.write(rows, "spans") if k else rows
        block = spark.sparkContext.broadcast(Block(items))
        rows = rows.mapInPandas(scan(block), f"{carried}spans array<bigint>, items array<string>, longest bigint, n_words bigint")
    rows = rows if "text" in keep else rows.drop("text")
    carried = carried if "text" in keep else carried.removesuffix("text string, ")
    rows = rows.mapInPandas(sums, f"{carried}spans array<bigint>, longest bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    back = dict(zip(rest, names, strict=True)) | {"text": "text"}
    return rows.select(*(F.col(back[c]).alias(c) for c in keep), "n_words", "n_hit", "n_items", "items_sha256", "longest", "spans")


def is_contaminated(hit: str = "n_hit", words: str = "n_words"):
    return (F.col(hit) > 0) & (F.lit(SHARE) * F.col(hit) >= F.col(words))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    return matches(spark, docs, benchmark).withColumn("contaminated", is_contaminated()).drop("spans")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns."""
    rows = matches(spark, docs, benchmark, [*docs.columns])
    extra = len(docs.columns)
    rows = rows.toDF(*(f"c{i}" for i in range(extra)), *rows.columns[extra:]).where(~is_contaminated())
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
