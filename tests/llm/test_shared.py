import random
import re

import numpy as np
import pandas as pd
import pytest

from medialoom.llm import shared


def test_words_are_where_the_pattern_finds_them():
    texts = ["Ab c,d 12x é.É", "", "x" * 10, " a\x00b\x7fc 日本 "]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seen: dict[int, str] = {}
    for t, h in zip(texts, shared.texts_words(texts, lower=False), strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        words = pattern.findall(low)
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist(), strict=True):
            assert seen.setdefault(x, w) == w


def test_long_words_and_segments(monkeypatch):
    text = "alpha beta " * 500 + "g" * 5000 + " delta"
    whole = next(shared.texts_words([text]))
    monkeypatch.setattr(shared, "SEGMENT", 64)
    assert (next(shared.texts_words([text])) == whole).all() and len(whole) == 1002


def test_shingles():
    h = next(shared.texts_words(["a b c d e f"]))
    assert len(shared.shingles(h, 5)) == 2 and len(shared.shingles(h[:3], 5)) == 1 and len(shared.shingles(h[:0], 5)) == 0
    assert (shared.shingles(h[:3], 5) != shared.shingles(h[:2], 5)).all()


def test_whole_groups():
    f = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    for cut in range(1, 6):
        got = [tuple(g["v"].iloc[a:b]) for g, c in shared.whole_groups(iter([f[:cut], f[cut:].reset_index(drop=True)]), ["k"]) for a, b in zip(c[:-1], c[1:], strict=True)]
        assert got == [(0, 1), (2, 3, 4), (5,)]


def test_local_roots():
    rng = random.Random(0)
    for _ in range(20):
        pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(20)]
        parent = list(range(30))
        find = lambda x: x if parent[x] == x else find(parent[x])  # noqa: B023,E731
        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        got = shared.local_roots(30, np.asarray([a for a, _ in pairs]), np.asarray([b for _, b in pairs]))
        assert got.tolist() == [find(x) for x in range(30)]


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(20)], [(0, i) for i in range(1, 15)] + [(40, 41), (41, 42), (42, 40)]])
def test_components(spark, edges):
    ws = shared.Workspace(spark, "test")
    got = {r.node: r.root for r in shared.components(ws, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {x: x for e in edges for x in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
