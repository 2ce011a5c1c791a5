"""Secret scanning by inferred grammars.

Labelled credentials are the values that the fixed patterns find, labelled by the pattern's kind. For each kind a prefix
tree of a bounded sample of them, over classes of characters, is generalised: states whose onward frequencies agree within
Hoeffding's bound, and whose successors do too, are merged (red-blue order), which leaves a probabilistic automaton of the
kind's format. Every candidate (a run of at least as many credential characters as the kind has at least; a run with dots
also by its parts, where it is not of a kind as a whole) of every text is then scored: its log likelihood per character
under the best automaton against that of ordinary text. Candidates at least as likely as all but the strangest of the
sample, and far likelier than ordinary text, are added to the spans of the patterns.

SAMPLE credentials of a kind at most are learned from, and LEAST_LABELLED at least; patterns, candidates and scores cover every
whole text.

Defined results: a null text is an empty one and has no spans; the automata of a corpus without credentials add nothing;
repeated rows get a row each; spans are in code points, end exclusive, in order of start, then of kind as listed, then of
end. An added span never overlaps one of the patterns. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import ARROW_ROWS

KINDS = ("assign", "access", "hex")
#: The patterns of the contract, and the least lengths of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

_assign = re.compile(ASSIGN.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{32,}")
_candidate = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
_part = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_hints = ("passw", "secret", "token", "api")

SAMPLE = 600
#: From fewer different credentials no format is learned: every state would be merged with every other.
LEAST_LABELLED = 20
ALPHA = 0.01
STRANGE = 0.02
FAR = 1.0
#: Verdicts that a grammar remembers.
KNOWN = 1 << 17


def class_of(c: str) -> str:
    """Digits, small and large letters up to f and beyond, and every sign for itself."""
    if "0" <= c <= "9":
        return "0"
    if c.isalpha():
        return ("a" if c <= "f" else "g") if c.islower() else ("A" if c <= "F" else "G")
    return c


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the patterns' matches."""
    out = []
    low = text.lower()
    if any(h in low for h in _hints):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


@dataclass
class State:
    count: int = 0
    ends: int = 0
    onward: dict[str, int] = field(default_factory=dict)  # class -> state
    taken: Counter = field(default_factory=Counter)  # class -> times
    chars: Counter = field(default_factory=Counter)


class Automaton:
    """A probabilistic automaton merged from the prefix tree of words."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.states = [State()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for w in words:
            at = 0
            for c in w:
                s, k = self.states[at], class_of(c)
                s.count += 1
                s.taken[k] += 1
                s.chars[c] += 1
                if k not in s.onward:
                    self.states.append(State())
                    s.onward[k] = len(self.states) - 1
                at = s.onward[k]
            self.states[at].count += 1
            self.states[at].ends += 1
        self.merge()
        self.level = -math.inf

    def differ(self, f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if self.differ(x.ends, x.count, y.ends, y.count):
                return False
            for k in {**x.taken, **y.taken}:
                if self.differ(x.taken[k], x.count, y.taken[k], y.count):
                    return False
                if k in x.onward and k in y.onward:
                    todo.append((x.onward[k], y.onward[k]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the automaton from a on."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.count += y.count
            x.ends += y.ends
            x.taken += y.taken
            x.chars += y.chars
            for k, to in y.onward.items():
                if k in x.onward:
                    todo.append((x.onward[k], to))
                else:
                    x.onward[k] = to

    def merge(self) -> None:
        red = [0]
        while True:
            blue = [(s, k) for s in red for k in sorted(self.states[s].onward) if self.states[s].onward[k] not in red]
            if not blue:
                break
            s, k = max(blue, key=lambda x: (self.states[self.states[x[0]].onward[x[1]]].count, -x[0], x[1]))
            b = self.states[s].onward[k]
            to = next((r for r in red if self.compatible(r, b)), None)
            if to is None:
                red.append(b)
            else:
                self.states[s].onward[k] = to
                self.fold(to, b)
        number = {s: i for i, s in enumerate(red)}
        self.states = [self.states[s] for s in red]
        for s in self.states:
            s.onward = {k: number[t] for k, t in s.onward.items()}
        self.cost = [{c: math.log((n + 0.01) / (s.count + 1)) for c, n in s.chars.items()} for s in self.states]

    def score(self, word: str) -> float:
        """Log likelihood per character; characters that a state never saw cost what its rarest would at a hundredth."""
        at, total = 0, 0.0
        for c in word:
            s = self.states[at]
            total += self.cost[at].get(c, math.log(0.01 / (s.count + 1)))
            at = s.onward.get(class_of(c), at)
        return total / max(1, len(word))


@dataclass
class Grammar:
    automata: dict[str, Automaton]
    ordinary: dict[str, float]
    known: dict[str, str | None] = field(default_factory=dict)

    def plain(self, word: str) -> float:
        return sum(self.ordinary.get(c, -9.0) for c in word) / max(1, len(word))

    def verdict(self, word: str) -> str | None:
        """The kind whose format the word has."""
        scores = {k: a.score(word) for k, a in self.automata.items() if len(word) >= LEAST[k]}
        best = max(((x - self.automata[k].level, k) for k, x in scores.items()), default=None)
        if best is None or best[0] < 0:
            return None
        return best[1] if scores[best[1]] - self.plain(word) >= FAR else None

    def kind_of(self, word: str) -> str | None:
        """verdict, remembered for words that come again."""
        if word not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = self.verdict(word)
        return self.known[word]


def infer(words: dict[str, list[str]], texts: list[str]) -> Grammar:
    """The automata of labelled words; texts show what ordinary characters are."""
    return grammar_of(words, Counter("".join(texts)))


def grammar_of(words: dict[str, list[str]], seen: dict[str, int]) -> Grammar:
    """The automata of labelled words, and how often each character is seen in texts."""
    automata = {}
    for kind, some in words.items():
        if len(some) >= LEAST_LABELLED:
            a = Automaton(some)
            a.level = float(np.quantile([a.score(w) for w in some], STRANGE))
            automata[kind] = a
    total = sum(seen.values()) + 1
    return Grammar(automata, {c: math.log((n + 0.5) / total) for c, n in seen.items()})


def characters(docs: DataFrame) -> dict[str, int]:
    """How often each code point occurs in all texts: a row of it for each partition, then one in all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for f in frames:
            for text in f["text"]:
                for at in range(0, len(text), 1 << 20):
                    found = np.bincount(np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32))
                    total[: len(found)] += found
        points = np.flatnonzero(total)
        yield pd.DataFrame({"point": points, "n": total[points]})

    rows = docs.select("text").where(F.col("text").isNotNull()).mapInPandas(run, "point int, n bigint")
    return {chr(r["point"]): r["n"] for r in rows.groupBy("point").agg(F.sum("n").alias("n")).collect()}


def train(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learns from at most `sample` different credentials of each kind, of each of so many buckets of hashes the one whose
    further hash is least, so that a sample looks like all credentials however many there are; and from the characters of
    all texts. What reaches the driver does not grow with the corpus."""
    some = docs.select("text").where(F.col("text").isNotNull())
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("words"), F.lit(LEAST[kind]).alias("least")) for kind, pattern, group in (("assign", _assign.pattern, 2), ("access", ACCESS, 0), ("hex", _hex.pattern, 0))))
    rows = some.select(F.explode(found).alias("f")).where(F.size("f.words") > 0)
    rows = rows.select("f.kind", "f.least", F.explode("f.words").alias("w")).where(F.length("w") >= F.col("least"))
    rows = rows.groupBy("kind", F.pmod(F.xxhash64("w"), F.lit(sample)).alias("bucket")).agg(F.min_by("w", F.struct(F.xxhash64(F.lit("drawn"), "w"), "w")).alias("w"))
    words: dict[str, list[str]] = {kind: [] for kind in KINDS}
    for r in rows.collect():
        words[r["kind"]].append(r["w"])
    return grammar_of({kind: sorted(w) for kind, w in words.items()}, characters(docs))


def added(grammar: Grammar, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of every candidate that has a kind's format and overlaps nothing taken; dots at the ends are not of it."""

    def found(start: int, w: str) -> tuple[int, int, str] | None:
        end, kind = start + len(w), grammar.kind_of(w)
        return None if kind is None or any(s < end and start < e for s, e in taken) else (start, end, kind)

    for m in _candidate.finditer(text):
        w = m[0].strip(".")
        if (whole := found(m.start() + m[0].index(w), w)) is not None:
            yield whole
        elif "." in w:
            yield from filter(None, (found(m.start() + p.start(), p[0]) for p in _part.finditer(m[0])))


def spans_of(grammar: Grammar, text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, name) of every span, base ones and added ones."""
    base = base_spans(text)
    out = [(s, k, e, KINDS[k]) for s, k, e in base]
    for start, end, kind in added(grammar, text, [(s, e) for s, _, e in base]):
        out.append((start, len(KINDS) + KINDS.index(kind), end, f"like_{kind}"))
    return sorted(out)


def secrets(spark: SparkSession, docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    shared = spark.sparkContext.broadcast(train(docs) if grammar is None else grammar)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                spans = spans_of(shared.value, text) if isinstance(text, str) else []
                said = [f"{name}:{s}:{e}" for s, _, e, name in spans]
                base = [x for x, (_, k, _, _) in zip(said, spans, strict=True) if k < len(KINDS)]
                n = Counter(name for _, _, _, name in spans)
                rows.append((doc_id, *(n[k] for k in KINDS), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said), len(said) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")
