"""A small corpus with everything that the operators must stand: nulls, empty and long texts, copies, repeated rows."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key_a string, vid string, size string, `score` string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "er", "ous", "th"], "de": ["sch", "ung", "ein", "ver", "ß"], "fr": ["eau", "oi", "é", "que", "le"]}
    word = lambda lang: "".join(rng.choices(syllables[lang], k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        lines = [" ".join(word(lang) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines), lang))
    for i in range(12):  # near copies
        words = rows[i % 6][1].split(" ")
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), rows[i % 6][2]))
    rows += [(200 + i, rows[7][1], "en") for i in range(5)]  # copies
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n\t ", None), (303, "... !!", "de"), (304, "x", None), (305, "one two three", "en"), (306, "one two three", "en")]
    rows += [(None, "a text without an id that goes on for a while so it has words", "en"), (400, rows[8][1], "en"), (400, rows[8][1], "en"), (401, "der " * 30000, "de"), (402, "w" * 50000, "en"), (403, "日本語 テスト " * 20, None)]
    return [(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), "clash", "clash", "clash", "clash") for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
