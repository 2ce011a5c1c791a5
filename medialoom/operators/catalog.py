"""Reads of the catalog: facets, counts, nested detail, lists, previews and the export queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.operators.search import primary_previews


def artist_facet(catalog) -> DataFrame:
    """Sets by effective artist (the set's own, else the project's), the unnamed last, then by number and name."""
    projects = catalog.projects.select(F.col("id").alias("project_id"), F.col("artist").alias("project_artist"))
    rows = catalog.sets.join(projects, "project_id").groupBy(F.coalesce("artist_override", "project_artist").alias("artist")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("artist").isNull(), F.desc("n"), F.lower("artist"))


def stats(catalog) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name in ("projects", "sets", "tracks", "devices", "samples", "previews", "export_jobs", "list_items"):
        one = getattr(catalog, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def set_detail(catalog) -> DataFrame:
    """Each set with its tracks and devices nested in order, and its number of samples."""
    tracks = catalog.tracks.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "name"))).alias("tracks"))
    devices = catalog.devices.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("kind", "manufacturer", "name"))).alias("devices"))
    samples = catalog.samples.groupBy("set_id").agg(F.count("*").alias("n_samples"))
    rows = catalog.sets.select(F.col("id").alias("set_id"), "als_path", "tempo")
    for part in (tracks, devices, samples):
        rows = rows.join(part, "set_id", "left")
    return rows.withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def detail_json(catalog) -> DataFrame:
    """set_detail as one JSON document a row."""
    return set_detail(catalog).select("set_id", F.to_json(F.struct("*")).alias("json"))


def kind_histogram(catalog) -> DataFrame:
    """Tracks of each kind in each set."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    return catalog.tracks.groupBy("set_id").agg(count("audio"), count("midi"), count("group"), count("return"))


def list_counts(catalog) -> DataFrame:
    """Lists by name with their number of items."""
    counts = catalog.list_items.groupBy("list_id").agg(F.count("*").alias("n_items"))
    rows = catalog.lists.join(counts, F.col("id") == F.col("list_id"), "left")
    return rows.select("id", "name", F.coalesce("n_items", F.lit(0)).alias("n_items")).orderBy(F.lower("name"), "id")


def list_membership(catalog) -> DataFrame:
    """Whether each set is in any list, and the names of its lists."""
    names = catalog.list_items.join(catalog.lists, F.col("list_id") == F.col("id")).groupBy("als_path").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("lists"))
    rows = catalog.sets.select("als_path").join(names, "als_path", "left")
    return rows.select("als_path", F.col("lists").isNotNull().alias("in_list"), F.coalesce("lists", F.lit("")).alias("lists"))


def primary_preview(catalog) -> DataFrame:
    return primary_previews(catalog.previews).select("set_id", "id", "audio_path", "source", "confidence")


def unpreviewed_projects(catalog) -> DataFrame:
    """Projects that have a set without any real preview (a sketch is none)."""
    real = catalog.previews.where(F.col("source") != "sketch").select(F.col("set_id").alias("id"))
    return catalog.sets.join(real, "id", "left_anti").select("project_id").distinct()


def wholly_unpreviewed_projects(catalog) -> DataFrame:
    """Projects no set of which has a real preview."""
    real = catalog.previews.where(F.col("source") != "sketch").select(F.col("set_id").alias("id"))
    with_one = catalog.sets.join(real, "id", "left_semi").select(F.col("project_id").alias("id"))
    return catalog.projects.join(with_one, "id", "left_anti").select("id", "name")


def previewed_projects(catalog) -> DataFrame:
    """Each project with whether any preview belongs to it itself or to one of its sets."""
    own = catalog.previews.where(F.col("project_id").isNotNull()).select("project_id")
    of_sets = catalog.previews.select("set_id").join(catalog.sets.select(F.col("id").alias("set_id"), "project_id"), "set_id").select("project_id")
    marked = own.union(of_sets).distinct()
    rows = catalog.projects.select("id").join(marked.select(F.col("project_id").alias("id"), F.lit(True).alias("has")), "id", "left")
    return rows.select("id", F.coalesce("has", F.lit(False)).alias("has_preview"))


def next_jobs(catalog, n: int = 1) -> DataFrame:
    """The n pending jobs that come next: the scored before the unscored, the easiest first, then the oldest."""
    rows = catalog.export_jobs.where(F.col("status") == "pending")
    return rows.orderBy(F.col("score").isNull(), F.desc("score"), F.asc("id")).limit(n).select("id", "set_id", "score")


def queue_display(catalog) -> DataFrame:
    """All jobs with their place in the queue's display: failed, completed, pending by score, processing; newest first."""
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "completed", 1).when(F.col("status") == "pending", 2).otherwise(3)
    return catalog.export_jobs.select("id", "status", rank.alias("rank"), F.when(F.col("status") == "pending", F.col("score")).alias("score")).orderBy("rank", F.desc_nulls_last("score"), F.desc("id"))


def unscored_pending(catalog) -> DataFrame:
    return catalog.export_jobs.agg(F.count_if((F.col("status") == "pending") & F.col("score").isNull()).alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def triaged(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """jobs(set_id, status, score, ...) with the scores(set_id, score) of those that are pending; the others keep theirs."""
    new = scores.select("set_id", F.col("score").alias("new"))
    score = F.when(F.col("status") == "pending", F.coalesce("new", "score")).otherwise(F.col("score"))
    return jobs.join(new, "set_id", "left").withColumn("score", score).drop("new")


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job by its log(job, ts, event_id, state), with its last event and their number."""
    rows = events.groupBy("job").agg(F.max(F.struct("ts", "event_id", "state")).alias("x"), F.count("*").alias("n_events"))
    return rows.select("job", "x.state", F.col("x.event_id").alias("last_event"), "n_events")


def suggestion_groups(catalog) -> DataFrame:
    """The suggestions of each set, best first, and the best confidence."""
    order = Window.partitionBy("set_id").orderBy(F.desc("confidence"), F.asc("id"))
    rows = catalog.previews.withColumn("n", F.row_number().over(order))
    grouped = rows.groupBy("set_id").agg(F.max("confidence").alias("best"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "audio_path"))), lambda x: x["audio_path"]), ",").alias("paths"))
    return grouped
