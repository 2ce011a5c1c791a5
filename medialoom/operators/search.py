"""Catalog search: optional filters, ranked prefix search over weighted fields, sort modes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions.names import basename, stem
from medialoom.session import written

# Weights of the indexed fields, and the parameters of bm25.
FIELD_WEIGHTS = {"project_name": 8.0, "set_name": 10.0, "track_names": 4.0, "device_names": 1.0, "sample_names": 0.5}
K1, B = 1.2, 0.75
ROLLING_DAYS = {"today": 1, "yesterday": 2, "week": 7, "month": 30}


def query_terms(raw: str | None) -> list[str]:
    """The maximal runs of letters and digits, each a prefix to look for; none: no text filter."""
    return re.findall(r"[^\W_]+", (raw or "").lower())


# Letters with accents of the Latin-1 range, and the plain ones they are compared as.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold_text(term: str) -> str:
    return term.translate(str.maketrans(ACCENTED, PLAIN))


def terms(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ranked(docs: DataFrame, key: str, fields: dict[str, float], raw: str) -> DataFrame:
    """(key, score) of the rows that hold a word beginning with each term of raw, in any field; the smaller the better.

    Words are matched and counted inside each row, in one pass over the texts without a term table; what stays of a row are a
    few numbers, written once. The number of rows, their mean length and each term's row count are aggregated from them, to one row.
    """
    wanted = [fold_text(t) for t in query_terms(raw)]
    rows = docs.select(F.col(key), *(terms(F.col(f)).alias(f"t_{i}") for i, f in enumerate(fields)))
    length = sum((F.size(f"t_{i}") for i in range(len(fields))), F.lit(0))
    begins = lambda q: lambda t: t.startswith(q)
    hits = [sum((w * F.size(F.filter(F.col(f"t_{i}"), begins(q))) for i, w in enumerate(fields.values())), F.lit(0.0)) for q in wanted]
    any_of = [F.array_max(F.array(*(F.exists(F.col(f"t_{i}"), begins(q)).cast("int") for i in range(len(fields))))) for q in wanted]
    rows = rows.select(key, length.alias("length"), *(h.alias(f"f_{k}") for k, h in enumerate(hits)), *(a.alias(f"a_{k}") for k, a in enumerate(any_of)))
    rows = written(rows, "ranked")
    totals = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum(f"a_{k}").alias(f"n_{k}") for k in range(len(wanted))))
    found = rows.where(" and ".join(f"a_{k} = 1" for k in range(len(wanted)))).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log((F.col("n") - F.col(f"n_{k}") + 0.5) / (F.col(f"n_{k}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f_{k}")
        score = score - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return found.select(key, score.alias("score"))


def joined(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The column's values of each set in order, with a space between; nulls left out."""
    every = F.sort_array(F.collect_list(F.struct(*order, column)))
    return rows.where(F.col(column).isNotNull()).groupBy("set_id").agg(F.array_join(F.transform(every, lambda x: x[column]), " ").alias(column))


def search_documents(catalog) -> DataFrame:
    """A row of indexed text for each set: its names, those of its tracks, devices and samples."""
    tracks = joined(catalog.tracks, "name", ["idx"]).withColumnRenamed("name", "track_names")
    devices = joined(catalog.devices, "name", []).withColumnRenamed("name", "device_names")
    samples = joined(catalog.samples.withColumn("file", basename(F.col("path"))), "file", []).withColumnRenamed("file", "sample_names")
    sets = catalog.sets.select(F.col("id").alias("set_id"), "project_id", stem(F.col("als_path")).alias("set_name"))
    rows = sets.join(catalog.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    for part in (tracks, devices, samples):
        rows = rows.join(part, "set_id", "left")
    return rows.select("set_id", *FIELD_WEIGHTS)


def primary_previews(previews: DataFrame) -> DataFrame:
    """The best preview of each set: greatest confidence, then newest, then least id."""
    order = Window.partitionBy("set_id").orderBy(F.desc("confidence"), F.desc("mtime"), F.asc("id"))
    return previews.where(F.col("set_id").isNotNull()).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


@dataclass
class Search:
    """What a search asks for; what is None does not filter."""

    text: str | None = None
    min_bpm: float | None = None
    max_bpm: float | None = None
    plugin: str | None = None
    artist: str | None = None
    has_preview: str | None = None
    list_id: int | None = None
    modified: str | None = None
    scanned: str | None = None
    sort_by: str | None = None
    now: datetime | None = None


def contains(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def since(keyword: str | None, now: datetime | None) -> datetime | None:
    """The bound of a rolling period; none for an unknown word."""
    days = ROLLING_DAYS.get(keyword or "")
    return None if days is None else (now or datetime.now(UTC).replace(tzinfo=None)) - timedelta(days=days)


def search(catalog, want: Search) -> DataFrame:
    """The sets that want describes, in its order. Predicates are added only when asked for, so that they reach the scan."""
    rows = catalog.sets
    if want.min_bpm is not None:
        rows = rows.where(F.col("tempo") >= want.min_bpm)
    if want.max_bpm is not None:
        rows = rows.where(F.col("tempo") <= want.max_bpm)
    if (bound := since(want.modified, want.now)) is not None:
        rows = rows.where(F.col("mtime") >= F.lit(bound))
    if want.plugin:
        rows = rows.join(catalog.devices.where(contains(F.col("name"), want.plugin)).select(F.col("set_id").alias("id")), "id", "left_semi")
    if want.list_id is not None:
        rows = rows.join(catalog.list_items.where(F.col("list_id") == want.list_id).select("als_path"), "als_path", "left_semi")
    projects = catalog.projects
    if (bound := since(want.scanned, want.now)) is not None:
        projects = projects.where(F.col("last_scanned") >= F.lit(bound))
    rows = rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), F.col("artist").alias("project_artist")), "project_id")
    rows = rows.withColumn("artist", F.coalesce("artist_override", "project_artist"))
    if want.artist:
        rows = rows.where(contains(F.col("artist"), want.artist))
    best = primary_previews(catalog.previews).select(F.col("set_id").alias("id"), "audio_path", "source")
    rows = rows.join(best, "id", "left")
    real = F.col("audio_path").isNotNull() & (F.col("source") != "sketch")
    if want.has_preview == "yes":
        rows = rows.where(real)
    elif want.has_preview == "no":
        rows = rows.where(~F.coalesce(real, F.lit(False)))
    ranks = query_terms(want.text)
    if ranks:
        rows = rows.join(ranked(search_documents(catalog), "set_id", FIELD_WEIGHTS, want.text).withColumnRenamed("set_id", "id"), "id")
    member = catalog.list_items.select("als_path", F.lit(True).alias("member")).distinct()
    rows = rows.join(member, "als_path", "left")
    ties = [F.asc("project"), F.asc("als_path")]
    order = {
        "modified": [F.desc("mtime"), *ties],
        "bpm": [F.desc_nulls_last("tempo"), *ties],
        "artist": [F.col("artist").isNull().asc(), F.asc("artist"), *ties],
        "previews": [F.col("audio_path").isNull().asc(), *ties],
    }.get(want.sort_by or "", ([F.asc("score")] if ranks else []) + ties)
    shown = [F.col("id").alias("set_id"), "project", "artist", "als_path", "tempo", F.col("audio_path").isNotNull().alias("has_preview"), F.col("source").alias("preview_source"), F.coalesce("member", F.lit(False)).alias("in_list")]
    return rows.orderBy(*order).select(*shown, *(["score"] if ranks else []))
