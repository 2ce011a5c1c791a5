"""Token counts without tokens: the number of pieces that a unigram tokenizer's Viterbi path has.

An Aho-Corasick automaton over the vocabulary enumerates every piece in a word; dynamic programming over the positions
carries the best score and the number of pieces of its path. No piece is cut out and no id is looked up. The tie rule is
the tokenizer's: at a position, pieces are weighed in order of their start, and only a greater score replaces what stands,
so of equal paths the one with the longest last piece wins. Where no piece of one character stands, that character is
unknown, at ten less than the least score; a run of unknown characters is one piece, or with byte fallback one piece for
each of its bytes.

The vocabulary and its scores come from a SentencePiece model file. Words are what stands between spaces, each after a
`▁`, as the tokenizers library's Metaspace cuts them (a `▁` in a text is a space, and a leading space is the first word's own); so a text's count is the sum of its words' counts, and each worker
remembers the counts of the words it has met (the memory is emptied when it is full).

Defined results: a null or empty text has no pieces; repeated rows get a row each; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import ARROW_ROWS

SPACE = "▁"
UNKNOWN_COST = 10.0
ROOM = 400_000


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores, id of unknown, whether bytes stand in) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]
    return pieces, model.unk_id(), any(model.is_byte(i) for i in range(model.get_piece_size()))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int, bytes_stand_in: bool, room: int = ROOM):
        import ahocorasick

        self.least = min(s for _, s in pieces) - UNKNOWN_COST
        self.bytes_stand_in = bytes_stand_in and all(f"<0x{b:02X}>" in dict(pieces) for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        self.room = room

    def word(self, w: str) -> int:
        """Pieces of one word, given with its `▁`. Pieces that end at one place come longest first, in order of their start."""
        best, count = [0.0] + [-math.inf] * len(w), [0] * (len(w) + 1)
        if self.singles.issuperset(w):
            for last, (length, score) in self.automaton.iter(w):
                start = last + 1 - length
                total = best[start] + score
                if total > best[last + 1]:
                    best[last + 1], count[last + 1] = total, count[start] + 1
            return count[-1]
        unknown, found, k = [False] * (len(w) + 1), list(self.automaton.iter(w)), 0
        for i, c in enumerate(w):
            while k < len(found) and found[k][0] == i:
                length, score = found[k][1]
                start = i + 1 - length
                total = best[start] + score
                if total > best[i + 1]:
                    best[i + 1], count[i + 1], unknown[i + 1] = total, count[start] + 1, False
                k += 1
            if c not in self.singles and best[i] + self.least > best[i + 1]:
                best[i + 1], unknown[i + 1] = best[i] + self.least, True
                count[i + 1] = count[i] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes_stand_in else 0 if unknown[i] else 1)
        return count[-1]

    def words(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        return [SPACE + w for w in text.removeprefix(" ").split(" ")] if text else []

    def texts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.room:
            self.known.clear()
        parts = [self.words(t) if isinstance(t, str) else [] for t in texts]
        known = self.known
        for part in parts:
            for w in set(part).difference(known):
                known[w] = self.word(w)
        get = known.__getitem__
        return [sum(map(get, p)) for p in parts]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The one of this Python worker."""
    if path not in _counters:
        _counters[path] = Counter(*vocabulary(path))
    return _counters[path]


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    path = path or model_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["n_tokens"] = counter(path).texts(f["text"].tolist())
            yield f[["doc_id", "n_tokens"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInPandas(run, f"doc_id {kind}, n_tokens bigint")
