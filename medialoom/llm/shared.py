"""What the operators of this subpackage share: a folder that driver and executors both see, text
hashing over byte arrays, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Rows in an Arrow batch: texts may be long, and two workers share an executor.
ARROW_ROWS = "500"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="medialoom-")
            _own[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


#: Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for a while; what they were before is put back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Named tables of one run, written under the shared folder so that losing an executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/medialoom/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """The rows of df, computed once and read back from the shared folder."""
        path = self.path(name)
        with conf(self.spark, **{CLEANUP: "true"}):
            df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.medialoom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that write() made and nothing will read again."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.medialoom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns memory that this Python worker no longer uses, as Arrow and the C library keep what they once had: two workers
    stand beside the JVM in an executor's memory, and a worker lives on for the stages that follow."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_key(text: Column | str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text, computed in the JVM: equal keys mean equal texts."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(7919), text).alias("key_b")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's argument, where a repeated expression would be computed anew."""
    return F.transform(F.array(value), body)[0]


def components(ws: Workspace, edges: DataFrame, name: str = "cc", most: int | None = None) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node of its connected component; after `most` rounds
    some node of it, the least that the node has been joined to so far.

    Alternating stars: every round joins each node's neighbours to the smallest of them, first the larger
    ones, then the smaller ones. Rounds are written to the shared folder, and nothing is collected but two sums.
    """
    now = ws.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    before, state = None, (-1, -1)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = ws.write(least, f"{name}-least")  # a table of its own, so that the join can be split at a node of many neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.write(large, f"{name}-large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = ws.write(small, f"{name}-small")
        ws.drop(large, least, now)
        if most is not None and (most := most - 1) <= 0:
            near = small.union(small.select("v", "v"))
            return near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        row = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now, before, state = small, state, (row["n"], row["s"])
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# Words and hashes ---------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
#: Bytes of words stay, A-Z become a-z, everything else separates: words are runs of 0-9, a-z and all beyond ASCII.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        n = max(n, SEGMENT + (SEGMENT >> 2))
        for k, base in (("up", _PRIME), ("down", _BACK)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _tables[k] = np.cumprod(t, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes that went through WORD_BYTES."""
    a = np.frombuffer(data, np.uint8) != 32
    edge = np.flatnonzero(np.diff(a.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start byte) of each word of bytes that went through WORD_BYTES, in pieces cut at separators."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut + 1
        piece = data[at:end]
        s, e = word_spans(piece)
        if len(s):
            up, down = _powers(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[np.frombuffer(piece, np.uint8)] * up[: len(piece)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s]))
            firsts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def batches(texts: list[str | None], lower: bool) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first index, joined bytes, offset of each text and of the end) in pieces of about SEGMENT bytes.

    lower: all letters become small, not only A-Z. Null is an empty text.
    """
    first, blobs, held = 0, [], 0
    for i, t in enumerate(texts):
        b = ((t.lower() if lower else t) if isinstance(t, str) else "").encode("utf-8", "surrogatepass")
        blobs.append(b)
        held += len(b) + 1
        if held >= SEGMENT:
            yield first, b"\n".join(blobs).translate(WORD_BYTES), np.cumsum([0] + [len(x) + 1 for x in blobs])
            first, blobs, held = i + 1, [], 0
    if blobs:
        yield first, b"\n".join(blobs).translate(WORD_BYTES), np.cumsum([0] + [len(x) + 1 for x in blobs])


def texts_words(texts: list[str | None], lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    for _, data, offsets in batches(texts, lower):
        h, s = word_hashes(data)
        cuts = np.searchsorted(s, offsets)
        for i in range(len(offsets) - 1):
            yield h[cuts[i] : cuts[i + 1]]


_STEPS = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `width` words; a shorter text, if it has words, is one run."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return np.asarray([mix(reduce(np.bitwise_xor, [mix(words[i : i + 1] * _STEPS[i]) for i in range(n)]) + np.uint64(n))[0]], np.uint64)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _STEPS[i]
    return np.unique(mix(total))


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From batches sorted by key: frames that hold whole groups, with the bounds of the groups in them."""
    held = None
    for f in frames:
        if not len(f):
            continue
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        k = f[key].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if not len(cuts):
            held = f
            continue
        done = f.iloc[: cuts[-1]]
        held = f.iloc[cuts[-1] :].reset_index(drop=True)
        yield done, np.concatenate([[0], cuts])
    if held is not None and len(held):
        yield held, np.asarray([0, len(held)])


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by left-right pairs, the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
