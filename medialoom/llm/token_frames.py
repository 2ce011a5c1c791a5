"""Token ids in seekable binary files.

A file holds the documents of one range of doc_id, in ascending order. Each document is one zstandard frame of its own
(a very long one: several), with the frame's own checksum; so a reader decompresses the documents it was asked for and
nothing else. Two skippable frames follow, which plain zstandard readers pass over:

* the document index (magic 0x184D2A50): for each document a null flag, doc_id, tokens and frames;
* the seek table (magic 0x184D2A5E) in the public seekable format: for each frame its compressed size, its plain size
  and the low 32 bits of the XXH64 of its plain bytes, then the number of frames, a descriptor byte and 0x8F92EAB1.

Ids are little-endian, of 2 bytes where the vocabulary fits, else of 4; bit 0 of the descriptor's reserved bits says which.

Defined results: a null text is encoded as an empty one; a null doc_id comes first; of equal doc_ids every row is kept,
in the order of a hash of their texts, so that one doc_id (or null) may fill many files. Extra columns are not read; an empty
table makes a manifest without files, and no rows. Tasks write under names of their own attempt, and the manifest lists the files of the
attempts that counted: a task that was lost and ran again leaves no trace in what is read. After each batch a worker gives back the
memory that it does not use; else several workers, which live on from stage to stage, outgrow an executor.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import Workspace, give_back

END_ID = 1
FRAME_TOKENS = 1 << 20
#: Latin words that the tokenizer gets as one text.
TOGETHER = 256
CACHE_CHUNKS = 400_000
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("tokens", "<u8"), ("frames", "<u4")])
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
#: Characters at which str.split() cuts though the tokenizer does not count them as white space.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: Beyond the Latin letters, marks begin, which the tokenizer composes before it makes letters small; and the one Latin letter
#: whose small form has a mark. Chunks with any of these go to the tokenizer as they are.
ODD_LETTERS = re.compile("[\u0130\u0250-\U0010ffff]")

#: Marks of ASCII at the end of a chunk: cut off the letters before them, as no letter follows. Not `>`, which ends special tokens.
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, by the tokenizers library, which sees each different chunk between white space once, and Latin words
    many in a text where the vocabulary marks the ends of words.

    The tokenizer cuts at white space before anything else, and neither its normaliser nor its special tokens reach
    across; so the ids of a text are those of its chunks in a row. Chunks are remembered in two halves: when the
    newer is full it becomes the older, whose chunks come back when they are met again, so that frequent ones stay.
    """

    def __init__(self, path: str, room: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.room, self.known, self.older = room, {}, {}
        self.ends = self.word_ends()
        if sys.byteorder != "little":
            raise OSError("files are little-endian, and so must be the machine")

    def word_ends(self) -> np.ndarray | None:
        """Whether an id ends a word, for each id, where the vocabulary marks that; else None."""
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        vocab = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return ends

    @staticmethod
    def chunks(text: str) -> list[str]:
        if any(c in text for c in ODD_SPACE):
            return [c for c in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if c]
        return text.split()

    def parts(self, text: str) -> list[str]:
        """The text's chunks, in small letters where that surely leaves their ids alone, so that fewer of them differ."""
        if "<|" in text:
            return self.chunks(text)
        if text.isascii() or not ODD_LETTERS.search(text):
            return self.chunks(text.lower())
        return [c if ODD_LETTERS.search(c) else c.lower() for c in self.chunks(text)]

    def plain(self, text: str | None) -> str:
        """The text with its parts between white space of ASCII."""
        if not isinstance(text, str):
            return ""
        if "<|" not in text and (text.isascii() or not ODD_LETTERS.search(text)):
            return text.lower()
        return " ".join(self.parts(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Arrow cuts the texts and numbers their different chunks; only these are looked up, then ids are gathered by number."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        if len(self.known) > self.room // 2:
            self.known, self.older = {}, self.known
        cut = pc.ascii_split_whitespace(pa.array([self.plain(t) for t in texts], pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, chunks))
        if missed := [k for k, x in enumerate(found) if x is None]:
            new = {chunks[k] for k in missed}
            if self.older:
                back = {c: self.older[c] for c in new if c in self.older}
                self.known.update(back)
                new.difference_update(back)
            self.learn(new)
            for k in missed:
                found[k] = self.known[chunks[k]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        pool, first = np.frombuffer(b"".join(found), self.type), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def learn(self, new: set[str]) -> None:
        """Encodes chunks. One of Latin letters before marks is cut by the tokenizer where the letters end, so its two halves
        are encoded instead, which other chunks have too. Latin words are encoded many at once."""
        known, halves = self.known, []
        for chunk in new:
            if chunk[-1:] in MARKS:
                word = chunk.rstrip(MARKS)
                if word.isalpha() and not ODD_LETTERS.search(word):
                    halves.append((chunk, word, chunk[len(word) :]))
        if halves:
            new = new.difference(c for c, _, _ in halves).union(w for _, w, _ in halves).union(e for _, _, e in halves).difference(known)
        words = [] if self.ends is None else [c for c in new if c.isalpha() and not ODD_LETTERS.search(c)]
        alone = list(new.difference(words))
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for k in range(0, len(groups), 100):
            some = groups[k : k + 100]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, self.type)
                at = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
                if len(at) != len(group) or at[-1] != ids.nbytes:
                    alone += group  # not one end for each word: they are encoded one by one
                    continue
                raw = ids.tobytes()
                known.update(zip(group, [raw[i:j] for i, j in zip([0, *at], at)], strict=True))
        for k in range(0, len(alone), 20_000):
            some = alone[k : k + 20_000]
            for chunk, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[chunk] = np.asarray(e.ids, self.type).tobytes()
        for chunk, word, end in halves:
            known[chunk] = known[word] + known[end]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The one of this Python worker: what it remembers serves its later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """One file: documents first, then the index and the seek table."""

    def __init__(self, stream, width: int, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.stream, self.width, self.index, self.seek = stream, width, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        step, frames = FRAME_TOKENS * self.width, 0
        for k in range(0, max(len(ids), 1), step):
            plain = ids[k : k + step]
            packed = self.pack(plain)
            self.stream.write(packed)
            self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            frames += 1
        self.index.append((doc_id is None, doc_id or 0, len(ids) // self.width, frames))

    def close(self) -> None:
        index, seek = np.asarray(self.index, INDEX).tobytes(), np.asarray(self.seek, SEEK).tobytes()
        word = lambda *x: np.asarray(x, "<u4").tobytes()
        foot = word(len(self.seek)) + bytes([0x80 | (self.width == 4)]) + word(FOOT_MAGIC)
        self.stream.write(word(INDEX_MAGIC, len(index)) + index + word(SEEK_MAGIC, len(seek) + len(foot)) + seek + foot)
        self.stream.close()


class FrameReader:
    """Reads the tables at a file's end, then only the frames it is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self.at(size - 9, 9)
        n, kind, magic = int.from_bytes(tail[:4], "little"), tail[4], int.from_bytes(tail[5:], "little")
        if magic != FOOT_MAGIC:
            raise ValueError("no seek table at the end of the file")
        self.width = 4 if kind & 1 else 2
        table = n * SEEK.itemsize
        self.seek = np.frombuffer(self.at(size - 9 - table, table), SEEK)
        ends = np.cumsum(self.seek["packed"].astype(np.int64))
        self.starts = ends - self.seek["packed"]
        body = int(ends[-1]) if n else 0
        self.index = np.frombuffer(self.at(body + 8, size - 9 - table - 8 - body - 8), INDEX)
        self.first = np.concatenate([[0], np.cumsum(self.index["frames"].astype(np.int64))])

    def at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        import xxhash
        import zstandard

        lo, hi = self.first[k], self.first[k + 1]
        raw, out = self.at(int(self.starts[lo]), int(self.seek["packed"][lo:hi].sum())), []
        unpack, at = zstandard.ZstdDecompressor().decompress, 0
        for f in range(lo, hi):
            plain = unpack(raw[at : at + int(self.seek["packed"][f])], max_output_size=int(self.seek["plain"][f]) or 1)
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.seek["check"][f]:
                raise ValueError(f"frame {f} does not match its checksum")
            out.append(plain)
            at += int(self.seek["packed"][f])
        return np.frombuffer(b"".join(out), f"<u{self.width}").astype(np.uint32)


def write_frames(spark: SparkSession, docs: DataFrame, where: str, tokenizer: str, end_id: int | None = END_ID) -> list[dict]:
    """Encodes docs(doc_id, text) into files in the folder `where`; the manifest's rows, in ascending order of doc_id."""
    from pyspark.sql.types import LongType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, out, n_docs, n_tokens = encoder(tokenizer), None, 0, 0
        end = b"" if end_id is None else np.asarray([end_id], coder.type).tobytes()
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        give_back()  # what the stages before have left in this worker
        for f in frames:
            ids = [None if x else int(i) for x, i in zip(f["none"], f["doc_id"], strict=True)]
            for doc_id, got in zip(ids, coder.encode(f["text"].tolist()), strict=True):
                if out is None:
                    store, folder = open_fs(where)
                    store.create_dir(folder, recursive=True)
                    out = FrameWriter(store.open_output_stream(f"{folder}/{name}", compression=None), coder.width)
                out.add(doc_id, got + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + (len(got) + len(end)) // coder.width
            give_back()
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "docs": [n_docs], "tokens": [n_tokens]})

    rows = docs.select(F.col("doc_id").cast(LongType()).alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    made = rows.mapInPandas(run, "part int, file string, docs bigint, tokens bigint").collect()  # a row for each file
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    store, folder = open_fs(where)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "files": manifest}).encode())
    return manifest


def read_manifest(where: str) -> list[dict]:
    store, folder = open_fs(where)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())["files"]


def read_frames(spark: SparkSession, where: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """From the files in `where`, a row for each document, or for each of doc_ids: doc_id, start, n_tokens, ids_crc32 and,
    with_ids, the ids. Frames of other documents stay packed."""
    wanted = None if doc_ids is None else np.asarray(sorted(doc_ids), np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_fs(where)
        for f in frames:
            for name, start in zip(f["file"], f["start"], strict=True):
                with store.open_input_file(f"{folder}/{name}") as source:
                    reader = FrameReader(source)
                    starts = start + np.concatenate([[0], np.cumsum(reader.index["tokens"].astype(np.int64))])
                    of = np.arange(len(reader.index)) if wanted is None else np.flatnonzero(np.isin(reader.index["doc_id"], wanted) & (reader.index["null"] == 0))
                    for k in range(0, len(of), 1000):
                        rows = []
                        for i in of[k : k + 1000]:
                            ids = reader.ids(i)
                            rows.append((None if reader.index["null"][i] else int(reader.index["doc_id"][i]), int(starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids.astype(np.int32),) if with_ids else ()))
                        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        yield out.astype({"doc_id": "Int64"})

    files = read_manifest(where)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(m["file"], m["start"]) for m in files], "file string, start bigint")
    return rows.repartition(len(files)).mapInPandas(run, schema)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, where: str | None = None) -> DataFrame:
    """Writes docs as token files and reads them back: a row per document."""
    where = where or Workspace(spark, "tokens").path("ids")
    write_frames(spark, docs, where, tokenizer or tokenizer_path())
    return read_frames(spark, where)
