"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles. In each of `runs` runs a set walks down a tree: at a node it
chooses every shingle whose hash under that node falls below 1 / (threshold * size of the set), and each chosen
shingle leads to a child. Two sets of Jaccard similarity at or above the threshold share at least one chosen child
on average at each node they share, so a node that is small enough is compared by brute force, a larger one is split
again, and what is still large after `depth` splits is compared block by block: nothing is dropped. Runs repeat until
the target recall: a pair at the threshold is missed by one run with probability 1/e where its nodes are small.

1. One pass over the texts makes a row per text: its size, its paths and a one-permutation sketch of 128 bytes.
   Equal texts are one class from here on, so thousands of copies are one row.
2. Small nodes are compared by sketch; each yields the edges of a forest, never all of its pairs. Connected
   components of these edges are candidate groups.
3. Each text of a candidate group is sent once to its group (large groups: once to every pair of blocks it is in),
   and every pair of the group is verified exactly. Links are counted there and components taken again.

Defined results: words are runs of letters and digits of the lower-cased text; a text of one to four words is one
shingle; a text without words, or null, links to nothing and is a class of its own. Repeated rows are copies of one
text. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialoom.llm.shared import Workspace, components, local_roots, mix, shingles, text_key, texts_words, whole_groups

THRESHOLD = 0.8
WIDTH = 5
RECALL = 0.99999
LEAF = 300
BLOCK = 256
BLOCK_SHINGLES = 1_500_000
BINS = 128
#: A pair at the threshold stays unless its sketches agree on less than this: six standard deviations below.
SKETCH_MARGIN = 0.2
DEPTH = 3


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold was missed by all with probability 1 - recall: one run misses it with 1/e."""
    return max(1, math.ceil(-math.log(1 - recall)))


def choose(tokens: np.ndarray, seeds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the seed, child) of every token that a node, given by its seed, chooses."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    nodes, children = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    step = max(1, 400_000 // len(tokens))
    for k in range(0, len(seeds), step):
        h = mix(tokens[None, :] ^ seeds[k : k + step, None])
        i, j = np.nonzero(h <= limit)
        nodes.append(i + k)
        children.append(mix(h[i, j] + seeds[k + i]))
    return np.concatenate(nodes), np.concatenate(children)


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation sketch: one byte of the least hash in each of BINS bins; 0 marks an empty bin."""
    h = mix(tokens ^ np.uint64(0x5BF03635))
    order = np.argsort(h)
    h = h[order]
    bins = (h & np.uint64(BINS - 1)).astype(np.int64)
    out = np.zeros(BINS, np.uint8)
    out[bins[::-1]] = ((mix(h[::-1]) >> np.uint64(8)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def profile(runs: int, threshold: float, width: int, depth: int):
    """mapInPandas over (key_a, key_b, text): the size, the paths of each level with their parents, and the sketch."""
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, b, words in zip(f["key_a"], f["key_b"], texts_words(f["text"].tolist()), strict=True):
                tokens = shingles(words, width)
                if not len(tokens):
                    continue
                row, nodes = [a, b, len(tokens), sketch(tokens)], seeds
                for _ in range(depth):
                    parent, child = choose(tokens, nodes, threshold)
                    row += [child.view(np.int64), nodes[parent].view(np.int64)]
                    nodes = child
                rows.append(row)
            yield pd.DataFrame(rows, columns=["key_a", "key_b", "size", "sketch", *(x for d in range(depth) for x in (f"path{d}", f"from{d}"))])

    return run


def alike(s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Which of s (rows of sketches with sizes n) may be similar to which of t."""
    same = np.zeros((len(s), len(t)), np.int32)
    either = np.zeros((len(s), len(t)), np.int32)
    for c in range(0, s.shape[1], 16):
        a, b = s[:, None, c : c + 16], t[None, :, c : c + 16]
        same += ((a == b) & (a != 0)).sum(2)
        either += ((a != 0) | (b != 0)).sum(2)
    fits = np.minimum(n[:, None], m[None, :]) >= threshold * np.maximum(n[:, None], m[None, :]) - 1e-9
    return fits & (same >= least * either)


def node_edges(least: float, threshold: float, sided: bool):
    """mapInPandas over rows sorted by node: edges (u, v) of a forest over the alike members of each node.

    sided: nodes are pairs of blocks, and only members of different sides are compared where there are two.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, cuts in whole_groups(frames, ["node"]):
            vid, size, sk = f["vid"].to_numpy(), f["size"].to_numpy(), np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), BINS)
            side = f["side"].to_numpy() if sided else None
            us, vs = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                left, right = (np.arange(lo, hi),) * 2
                if sided and (side[lo:hi] == 1).any():
                    left, right = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                i, j = [], []
                for k in range(0, len(left), 64):
                    p, q = np.nonzero(alike(sk[left[k : k + 64]], sk[right], size[left[k : k + 64]], size[right], least, threshold))
                    i.append(left[k + p])
                    j.append(right[q])
                i, j = np.concatenate(i), np.concatenate(j)
                if not len(i):
                    continue
                root = local_roots(hi - lo, i - lo, j - lo) + lo
                moved = np.flatnonzero(root != np.arange(lo, hi)) + lo
                us.append(vid[moved])
                vs.append(vid[root[moved - lo]])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b: a product of 0/1 matrices, some columns at a time."""
    if len(a) == 1 or len(b) == 1:
        return np.asarray([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    every = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - k * width] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return np.rint(out).astype(np.int64)


def verify(threshold: float):
    """mapInPandas over rows sorted by pair of blocks: for each member its number of verified links there, and an edge to the smallest text it hangs together with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, cuts in whole_groups(frames, ["comp", "block_i", "block_j"]):
            out = []
            vids, sides = f["vid"].to_numpy(), (f["block"] == f["block_i"]).to_numpy()
            alone = (f["block_i"] == f["block_j"]).to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                _, once = np.unique(vids[lo:hi], return_index=True)
                rows = lo + np.sort(once)
                tokens = {r: np.frombuffer(f["tokens"].iat[r], np.uint64) for r in rows}
                a = [r for r in rows if sides[r]]
                b = a if alone[lo] else [r for r in rows if not sides[r]]
                if not a or not b:
                    continue
                inter = intersections([tokens[r] for r in a], [tokens[r] for r in b])
                na, nb = np.asarray([len(tokens[r]) for r in a]), np.asarray([len(tokens[r]) for r in b])
                linked = inter >= threshold * (na[:, None] + nb[None, :] - inter) - 1e-9
                if alone[lo]:
                    np.fill_diagonal(linked, False)
                i, j = np.nonzero(linked)
                where = {r: k for k, r in enumerate(rows)}
                ia, ib = np.asarray([where[r] for r in a]), np.asarray([where[r] for r in b])
                root = local_roots(len(rows), ia[i], ib[j]) if len(i) else np.arange(len(rows))
                links = np.zeros(len(rows), np.int64)
                np.add.at(links, ia, linked.sum(1))
                if not alone[lo]:
                    np.add.at(links, ib, linked.sum(0))
                some = np.flatnonzero(links)
                out.append(np.stack([vids[rows[some]], vids[rows[root[some]]], links[some]]))
            if out:
                u, v, n = np.concatenate(out, axis=1)
                yield pd.DataFrame({"u": u, "v": v, "links": n})

    return run


def tokens_of(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["tokens"] = [shingles(w, width).tobytes() for w in texts_words(f["text"].tolist())]
            yield f.drop(columns="text")

    return run


def candidate_edges(ws: Workspace, sets: DataFrame, threshold: float, leaf: int, depth: int) -> DataFrame:
    """Edges between texts whose sketches are alike in a shared node, over all nodes of all runs.

    Rows of (node, text) stay narrow until the nodes of one text are gone; only then the sketches join them.
    """
    least = max(0.0, threshold - SKETCH_MARGIN)
    schema, out, heavy = "u bigint, v bigint", [], None
    small = sets.select("vid", "size", "sketch")
    for d in range(depth):
        rows = sets.select("vid", F.explode(F.arrays_zip(F.col(f"path{d}").alias("n"), F.col(f"from{d}").alias("p"))).alias("x")).select("vid", F.col("x.n").alias("node"), F.col("x.p").alias("parent"))
        if heavy is not None:
            rows = ws.write(rows.join(heavy.select(F.col("node").alias("parent")), "parent", "left_semi"), f"rows{d}")
        rows = rows.drop("parent")
        counts = ws.write(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"counts{d}")
        light = rows.join(counts.where(F.col("n") <= leaf).select("node"), "node").join(small, "vid")
        light = light.repartition("node").sortWithinPartitions("node")
        out.append(ws.write(light.mapInPandas(node_edges(least, threshold, False), schema), f"light{d}"))
        heavy = counts.where(F.col("n") > leaf)
        if heavy.isEmpty():
            return _union(out)
    blocks = heavy.select("node", F.ceil(F.col("n") / leaf).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    pairs = dealt.select("vid", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "vid", (F.col("block") > F.col("other")).cast("int").alias("side"))
    pairs = pairs.join(small, "vid").repartition("node").sortWithinPartitions("node")
    out.append(ws.write(pairs.mapInPandas(node_edges(least, threshold, True), schema), "heavy"))
    return _union(out)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def text_groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """A row for each different text that has words: key_a, key_b, keeper_id (least doc_id of the text), n_copies (rows with
    it), n_links (other texts linked to it), class_id (least doc_id of its component) and stays (first of its component)."""
    ws = Workspace(spark, "jaccard")
    keyed = docs.select("doc_id", "text", *text_key()).where(F.col("text").isNotNull())
    fields = "key_a bigint, key_b bigint, size bigint, sketch binary" + "".join(f", path{d} array<bigint>, from{d} array<bigint>" for d in range(depth))
    made = keyed.select("key_a", "key_b", "text").mapInPandas(profile(runs_for(recall), threshold, width, depth), fields)
    sets = ws.write(made.dropDuplicates(["key_a", "key_b"]).withColumn("vid", F.monotonically_increasing_id()), "sets")
    comps = ws.write(components(ws, candidate_edges(ws, sets, threshold, leaf, depth), "candidates").withColumnsRenamed({"node": "vid", "root": "comp"}), "comps")

    members = comps.join(sets.select("vid", "key_a", "key_b", "size"), "vid")
    totals = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = ws.write(members.join(totals, "comp").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")), "members")
    one = keyed.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("keeper_id"), F.count("*").alias("n_copies"))
    one = ws.write(one.join(sets.select("key_a", "key_b", "vid"), ["key_a", "key_b"]), "classes")
    wanted = members.join(one.select("vid", "keeper_id"), "vid").withColumnRenamed("keeper_id", "doc")
    sent = keyed.join(wanted, (keyed.key_a == wanted.key_a) & (keyed.key_b == wanted.key_b) & keyed.doc_id.eqNullSafe(wanted.doc)).select("vid", "comp", "blocks", "block", "text")
    sent = sent.mapInPandas(tokens_of(width), "vid bigint, comp bigint, blocks int, block int, tokens binary")
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("vid", "comp", "block", "tokens", F.least("block", "other").alias("block_i"), F.greatest("block", "other").alias("block_j"))
    keys = ["comp", "block_i", "block_j"]
    found = ws.write(sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(verify(threshold), "u bigint, v bigint, links bigint"), "found")

    roots = ws.write(components(ws, found.select("u", "v"), "verified"), "roots")
    links = found.groupBy("u").agg(F.sum("links").alias("n_links"))
    out = one.join(roots, one.vid == roots.node, "left").join(links, one.vid == links.u, "left")
    out = out.select("key_a", "key_b", "keeper_id", "n_copies", F.coalesce("root", "vid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = F.struct(F.col("keeper_id").isNull().alias("none"), "keeper_id", "key_a", "key_b")
    least = out.groupBy("root").agg(F.min(first).alias("first"))
    out = out.join(least, "root").withColumns({"class_id": F.col("first.keeper_id"), "stays": (F.col("key_a") == F.col("first.key_a")) & (F.col("key_b") == F.col("first.key_b"))})
    return ws.write(out.drop("root", "first"), "groups")


def jaccard_join(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of the documents it hangs together with through links; its own
    if none), n_links (other texts of similarity at or above the threshold) and n_copies (rows with its very text)."""
    groups = text_groups(spark, docs, **options)
    keyed = docs.select("doc_id", *text_key(), F.col("text").isNull().alias("none"))
    keyed = keyed.select("doc_id", F.when(~F.col("none"), F.col("key_a")).alias("key_a"), "key_b")
    return keyed.join(groups, ["key_a", "key_b"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
    )


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of every group the one with the least doc_id (null last), and every text without words.
    Of rows that repeat a doc_id with its text the first by its other columns stays. docs may have columns of any names."""
    groups = text_groups(spark, docs.select("doc_id", "text"), **options).where("stays").select("key_a", "key_b", "keeper_id")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    has_words = F.coalesce(text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    keyed = docs.toDF(*names).select("*", *(k.alias(n) for k, n in zip(text_key(text), ("ka", "kb"), strict=True)), has_words.alias("words"))
    rows = keyed.join(groups, (F.col("ka") == F.col("key_a")) & (F.col("kb") == F.col("key_b")) & doc_id.eqNullSafe(F.col("keeper_id")), "left")
    rows = rows.where(~F.col("words") | F.col("key_a").isNotNull())
    rest = [F.col(n) for n, (c, kind) in zip(names, docs.dtypes, strict=True) if c not in ("doc_id", "text") and not kind.startswith("map")]
    order = Window.partitionBy("ka", "kb", doc_id).orderBy(*(rest or [doc_id]))
    rows = rows.withColumn("n", F.row_number().over(order)).where(~F.col("words") | (F.col("n") == 1))
    return rows.select(*names).toDF(*docs.columns)
