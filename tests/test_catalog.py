import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from medialoom.operators import catalog as reads
from medialoom.operators import ingest, search
from medialoom.plans import registry


class Tables:
    """A catalog of hand-written rows."""

    def __init__(self, spark, **tables):
        self.spark = spark
        empty = {
            "projects": "id bigint, folder_path string, name string, artist string, last_scanned timestamp",
            "sets": "id bigint, project_id bigint, als_path string, tempo double, mtime timestamp, artist_override string",
            "tracks": "set_id bigint, idx int, kind string, name string",
            "devices": "set_id bigint, name string, manufacturer string, kind string",
            "samples": "set_id bigint, path string",
            "previews": "id bigint, set_id bigint, audio_path string, source string, confidence double, mtime timestamp",
            "list_items": "list_id bigint, als_path string",
            "lists": "id bigint, name string",
        }
        for name, schema in empty.items():
            setattr(self, name, spark.createDataFrame(tables.get(name, []), schema))


T = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def two(spark):
    return Tables(
        spark,
        projects=[(1, "/lib/burial/untrue", "untrue", "Burial", T), (2, "/lib/2024/jan/sketch", "be 131.10 bpm", None, T)],
        sets=[(1, 1, "/lib/s1.als", 131.1, T, None), (2, 1, "/lib/s2.als", 90.0, datetime(2023, 1, 1), "Four Tet"), (3, 2, "/lib/be.als", None, T, None)],
        devices=[(1, "Serum", "Xfer", "vst3"), (2, "Operator", "Ableton", "native")],
        previews=[(1, 1, "/a.wav", "sketch", 1.0, T), (2, 2, "/b.wav", "manual", 0.5, T), (3, 2, "/c.wav", "manual", 0.5, datetime(2024, 2, 1))],
        lists=[(1, "Favorites"), (2, "to mix")],
        list_items=[(1, "/lib/s1.als"), (2, "/lib/s1.als")],
    )


def ids(df):
    return [r["set_id"] for r in df.collect()]


def test_effective_artist(two):
    assert ids(search.search(two, search.Search(artist="burial"))) == [1]
    assert ids(search.search(two, search.Search(artist="FOUR"))) == [2]
    assert {(r.artist, r.n) for r in reads.artist_facet(two).collect()} == {("Burial", 1), ("Four Tet", 1), (None, 1)}
    assert reads.artist_facet(two).collect()[-1].artist is None


def test_filters(two):
    assert ids(search.search(two, search.Search(min_bpm=100))) == [1]
    assert ids(search.search(two, search.Search(max_bpm=100))) == [2]
    assert ids(search.search(two, search.Search(plugin="ser"))) == [1]
    assert ids(search.search(two, search.Search(list_id=1))) == [1]
    assert ids(search.search(two, search.Search(has_preview="yes"))) == [2]
    assert set(ids(search.search(two, search.Search(has_preview="no")))) == {1, 3}
    assert set(ids(search.search(two, search.Search(modified="week", now=T)))) == {1, 3}
    assert len(ids(search.search(two, search.Search(modified="whenever", now=T)))) == 3


def test_orders(two):
    assert ids(search.search(two, search.Search(sort_by="bpm"))) == [1, 2, 3]
    assert ids(search.search(two, search.Search(sort_by="artist")))[-1] == 3
    assert ids(search.search(two, search.Search())) == [3, 1, 2]


def test_flag_and_primary(two):
    rows = {r.set_id: r for r in search.search(two, search.Search()).collect()}
    assert rows[1].has_preview and rows[1].preview_source == "sketch" and rows[1].in_list
    assert not rows[3].has_preview and not rows[3].in_list
    assert {r.set_id: r.id for r in search.primary_previews(two.previews).collect()} == {1: 1, 2: 3}


def test_text(two):
    assert ids(search.search(two, search.Search(text="131.10"))) == [3]
    assert len(ids(search.search(two, search.Search(text="...")))) == 3


def test_bm25_against_fts5(spark):
    import random

    rng = random.Random(3)
    words = ["kick", "kicker", "snare", "pad", "bass", "élan", "808", "x"]
    rows = [(i, *(" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(3))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, a, b, c)")
    db.executemany("insert into t values (?,?,?,?)", rows)
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    for text in ("kick", "kick sn", "elan", "808 ba"):
        match = " ".join(f'"{q}"*' for q in search.query_terms(text))
        want = dict(db.execute("select id, bm25(t, 0.0, 8.0, 4.0, 0.5) from t where t match ?", (match,)).fetchall())
        got = {r.id: r.score for r in search.ranked(df, "id", {"a": 8.0, "b": 4.0, "c": 0.5}, text).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ingest(spark):
    stored = spark.createDataFrame([("/a", "a", "Burial"), ("/b", "b", None)], "folder_path string, name string, artist string")
    new = spark.createDataFrame([("/a", "A", None), ("/c", "c", "New")], stored.schema)
    assert {tuple(r) for r in ingest.upsert_projects(stored, new).collect()} == {("/a", "A", "Burial"), ("/b", "b", None), ("/c", "c", "New")}
    assert {tuple(r) for r in ingest.replace_by_key(stored, new, "folder_path").collect()} == {("/a", "A", None), ("/b", "b", None), ("/c", "c", "New")}
    twice = ingest.insert_missing(stored, new.union(new), F.lower("folder_path"))
    assert {tuple(r) for r in twice.collect()} == {("/a", "a", "Burial"), ("/b", "b", None), ("/c", "c", "New")} and twice.count() == 3


def test_prune_leaves_neighbours(spark):
    stored = spark.createDataFrame([("/lib/a.als",), ("/lib/b.als",), ("/library/c.als",)], "als_path string")
    seen = stored.where("als_path = '/lib/a.als'")
    assert {r[0] for r in ingest.prune_missing(stored, seen, "/lib").collect()} == {"/lib/a.als", "/library/c.als"}


def test_queue(spark):
    stored = spark.createDataFrame([(1, "processing", 0.5), (2, "failed", 0.4)], "set_id bigint, status string, score double")
    got = ingest.queue_jobs(stored, spark.createDataFrame([(1,), (2,), (3,)], "set_id bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, "processing", 0.5, False), (2, "pending", None, True), (3, "pending", None, True)}


def test_every_query_has_rows(spark):
    assert registry.queries()["search_filtered"](spark, "/root/testdata/sf0.001").count() > 0
