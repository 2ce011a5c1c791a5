"""Every catalog query by name, over the adapted tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.adapters import Catalog
from medialoom.functions import kernels, names
from medialoom.operators import catalog as reads
from medialoom.operators import graph, ingest, matching, search, timeline

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
NOW = datetime(2024, 2, 1)


def query(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
    """Registers f under its name."""
    _queries[f.__name__] = lambda spark, folder: f(Catalog(spark, folder))
    return f


def queries() -> dict[str, Query]:
    from medialoom.plans import readers  # noqa: F401  registers its own

    return dict(_queries)


def r6(column):
    """Six decimals: what two engines agree on for a continuous result."""
    return F.round(column, 6)


@query
def search_filtered(c: Catalog) -> DataFrame:
    want = search.Search(min_bpm=100, max_bpm=160, plugin="promo", has_preview="yes", sort_by="bpm")
    return search.search(c, want).drop("in_list")


@query
def search_by_list_and_artist(c: Catalog) -> DataFrame:
    return search.search(c, search.Search(artist="nation_1", list_id=3, sort_by="artist")).drop("has_preview", "preview_source")


@query
def search_recent_without_preview(c: Catalog) -> DataFrame:
    now = c.table("orders").agg(F.max("o_orderdate")).first()[0]
    return search.search(c, search.Search(has_preview="no", modified="month", sort_by="modified", now=now)).drop("preview_source")


@query
def search_bm25(c: Catalog) -> DataFrame:
    docs = c.table("documents").select("doc_id", "text")
    return search.ranked(docs, "doc_id", {"text": 1.0}, "thor re").select("doc_id", r6("score").alias("score")).orderBy("score", "doc_id")


@query
def search_bm25_multifield(c: Catalog) -> DataFrame:
    rows = search.ranked(search.search_documents(c), "set_id", search.FIELD_WEIGHTS, "promo 12")
    return rows.select("set_id", r6("score").alias("score"))


@query
def artist_facet(c: Catalog) -> DataFrame:
    return reads.artist_facet(c)


@query
def catalog_stats(c: Catalog) -> DataFrame:
    return reads.stats(c)


@query
def set_detail_nested(c: Catalog) -> DataFrame:
    flat = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",")
    return reads.set_detail(c).select("set_id", "als_path", "tempo", flat("tracks", "idx", "kind", "name").alias("tracks"), flat("devices", "kind", "manufacturer", "name").alias("devices"), "n_samples")


@query
def kind_histogram(c: Catalog) -> DataFrame:
    return reads.kind_histogram(c)


@query
def list_counts(c: Catalog) -> DataFrame:
    return reads.list_counts(c)


@query
def list_membership(c: Catalog) -> DataFrame:
    return reads.list_membership(c)


@query
def primary_preview(c: Catalog) -> DataFrame:
    return reads.primary_preview(c)


@query
def suggestion_groups(c: Catalog) -> DataFrame:
    return reads.suggestion_groups(c)


@query
def best_match_names(c: Catalog) -> DataFrame:
    part = c.table("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    renders = part.select("id", names.normalize(F.concat("name", F.lit("bpm FINAL v2 [2024-01-01]"))).alias("norm"))
    return matching.best_matches(renders, part.select("id", names.normalize(F.col("name")).alias("norm"))).select("render_id", "set_id", r6("score").alias("score"))


@query
def known_sample_guard(c: Catalog) -> DataFrame:
    path = F.concat(F.lit("/samples/"), F.upper("p_brand"), F.lit("/"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " alt").otherwise(""), F.lit(".WAV"))
    files = c.table("part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    return matching.known_sample_guard(files, c.samples)


@query
def unpreviewed_projects(c: Catalog) -> DataFrame:
    return reads.unpreviewed_projects(c)


@query
def wholly_unpreviewed_projects(c: Catalog) -> DataFrame:
    return reads.wholly_unpreviewed_projects(c)


@query
def previewed_projects_union(c: Catalog) -> DataFrame:
    return reads.previewed_projects(c)


def _files(c: Catalog) -> DataFrame:
    """A listing in which the samples of every third part are files, and of every third plus one placeholders."""
    part = c.table("part").select("p_partkey", F.concat(F.lit("/Samples/"), "p_brand", F.lit("/")).alias("dir"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("file"))
    there = part.where("p_partkey % 3 = 0").select(F.concat("dir", "file").alias("path"))
    hollow = part.where("p_partkey % 3 = 1").select(F.concat("dir", F.lit("."), "file", F.lit(".icloud")).alias("path"))
    return there.union(hollow)


@query
def sample_states(c: Catalog) -> DataFrame:
    return matching.sample_states(c.samples.select("path").distinct(), _files(c)).groupBy("state").agg(F.count("*").alias("n"))


@query
def renderability(c: Catalog) -> DataFrame:
    part = c.table("part")
    inventory = part.where("p_type not in ('PROMO', 'SMALL')").select(F.explode(F.array(names.normalize(F.col("p_type")), names.normalize(F.concat("p_brand", F.lit(" kit"))))).alias("norm")).distinct()
    rows = matching.render_scores(c.sets, c.devices, matching.sample_states(c.samples, _files(c)), inventory)
    return rows.select("set_id", r6("score").alias("score"), "plugins_total", F.array_join("missing_plugins", ",").alias("missing_plugins"), "samples_total", "samples_missing", "samples_evicted")


@query
def job_queue_next(c: Catalog) -> DataFrame:
    return reads.next_jobs(c, 50)


@query
def job_queue_display(c: Catalog) -> DataFrame:
    return reads.queue_display(c)


@query
def job_queue_counts(c: Catalog) -> DataFrame:
    return reads.unscored_pending(c)


@query
def job_queue_requeue(c: Catalog) -> DataFrame:
    wanted = c.sets.where("id % 3 = 0").select(F.col("id").alias("set_id"))
    return ingest.queue_jobs(c.export_jobs.select("set_id", "status", "score"), wanted)


@query
def job_state_fold(c: Catalog) -> DataFrame:
    return reads.job_states(c.job_events).withColumnRenamed("job", "user_id")


def _stored(c: Catalog) -> DataFrame:
    return c.sets.where("id % 10 <> 3").select("als_path", "id", F.when(F.col("id") % 7 == 1, F.col("id") + 1).otherwise(F.col("id")).alias("file_size"), "mtime")


@query
def freshness_diff(c: Catalog) -> DataFrame:
    listing = c.sets.select("als_path", F.col("id").alias("file_size"), "mtime")
    return ingest.changed_files(listing, _stored(c))


@query
def prune_missing(c: Catalog) -> DataFrame:
    return ingest.prune_missing(_stored(c), c.sets.where("id % 4 <> 0").select("als_path"), "/lib/1-URGENT")


@query
def upsert_coalesce(c: Catalog) -> DataFrame:
    stored = c.projects.where("id % 3 <> 0").select("folder_path", "name", "artist")
    new = c.projects.where("id % 2 = 0").select("folder_path", F.upper("name").alias("name"), F.when(F.col("id") % 4 == 0, F.lit("New Artist")).alias("artist"))
    return ingest.upsert_projects(stored, new)


@query
def replace_sets(c: Catalog) -> DataFrame:
    rows = c.sets.select("als_path", "id", "tempo")
    return ingest.replace_by_key(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").withColumn("tempo", F.lit(120.0)), "als_path")


@query
def insert_if_absent(c: Catalog) -> DataFrame:
    items = c.list_items
    return ingest.insert_missing(items, c.sets.where("id % 14 = 0 or id % 9 = 0").select((F.col("id") % 5).alias("list_id"), "als_path"), "list_id", "als_path")


@query
def artist_tagging(c: Catalog) -> DataFrame:
    changes = c.sets.where("id % 6 = 0").select("als_path", F.when(F.col("id") % 4 == 0, F.lit("Tagged")).alias("value"))
    return ingest.set_artists(c.sets.select("id", "als_path", "artist_override"), changes, "als_path", "artist_override")


@query
def relink_votes(c: Catalog) -> DataFrame:
    rows = c.table("lineitem").select(F.concat(F.lit("/s/"), F.col("l_suppkey").cast("string")).alias("folder"), F.col("l_partkey").cast("string").alias("file"), "l_suppkey")
    return matching.relink_votes(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"))


@query
def sample_lookup_tiers(c: Catalog) -> DataFrame:
    part = c.table("part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    files = part.where("id % 2 = 0").select(F.concat(F.lit("/f/"), "p_name", F.lit(" "), F.col("id").cast("string"), F.when(F.col("id") % 4 == 0, ".wav").otherwise(".aif")).alias("path"), F.col("p_size").cast("long").alias("mtime"))
    missing = part.select("id", F.concat("p_name", F.lit("_"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), (F.col("id") * 2).cast("string"))).otherwise(F.col("id").cast("string")), F.lit(".wav")).alias("name"))
    return matching.sample_lookup(missing, files).select("id", "path", "tier", "rank")


@query
def artist_from_path(c: Catalog) -> DataFrame:
    part = c.table("part")
    folder = F.concat(F.lit("/lib/"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("artists/"), "p_brand", F.lit("/"))).when(F.col("p_partkey") % 4 == 1, F.concat((1990 + F.col("p_size")).cast("string"), F.lit("/march/"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Projects/"), "p_type", F.lit("/"))).otherwise(F.lit("")), "p_name", F.lit(" Project"))
    return part.select(F.col("p_partkey").alias("id"), names.artist_of(F.lit("/lib"), folder).alias("artist"))


@query
def tempo_band(c: Catalog) -> DataFrame:
    """Each set with those that come within the band after it in order of tempo."""
    return graph.tempo_neighbours(c.sets.select("id", "tempo")).select("id", "other")


@query
def tempo_kernel_pairs(c: Catalog) -> DataFrame:
    a, b = c.sets.select("project_id", F.col("id").alias("a"), F.col("tempo").alias("ta")), c.sets.select("project_id", F.col("id").alias("b"), F.col("tempo").alias("tb"))
    return a.join(b, "project_id").where("a <> b").select("a", "b", r6(kernels.tempo_kernel(F.col("ta"), F.col("tb"))).alias("fit"))


@query
def sample_jaccard_knn(c: Catalog) -> DataFrame:
    """Projects by the samples of their sets: the ten nearest of those that share one that is not in every other project."""
    rows = c.samples.join(c.sets.select(F.col("id").alias("set_id"), "project_id"), "set_id").select("project_id", F.xxhash64("path").alias("path")).distinct()
    common = rows.groupBy("path").agg(F.count("*").alias("g")).where(f"g > {graph.LINK_CAP}").select("path", F.lit(True).alias("common"))
    rows = rows.join(common, "path", "left")
    own = rows.groupBy("project_id").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("common"), F.col("path"))).alias("often"), F.collect_list(F.when(F.col("common").isNull(), F.col("path"))).alias("seldom"))
    own = own.select("project_id", "n", "often", F.explode("seldom").alias("path"))
    side = lambda p: own.select("path", F.struct(F.col("project_id").alias("id"), "n", "often").alias(p))
    both = side("a").join(side("b"), "path").where("a.id < b.id").groupBy("a", "b").agg(F.count("*").alias("both"))
    both = both.withColumn("both", F.col("both") + F.size(F.array_intersect("a.often", "b.often")))
    w = r6(kernels.jaccard(F.col("both"), F.col("a.n"), F.col("b.n")))
    ways = F.array(F.struct(F.col("a.id").alias("a"), F.col("b.id").alias("b"), w.alias("w")), F.struct(F.col("b.id").alias("a"), F.col("a.id").alias("b"), w.alias("w")))
    order = search.Window.partitionBy("a").orderBy(F.desc("w"), "b")
    return both.select(F.explode(ways).alias("e")).select("e.*").withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@query
def name_tfidf_cosine(c: Catalog) -> DataFrame:
    rows = graph.features(c)
    pairs = rows.select("project_id", F.col("id").alias("a"), F.col("words").alias("wa")).join(rows.select("project_id", F.col("id").alias("b"), F.col("words").alias("wb")), "project_id").where("a < b")
    n = rows.agg(F.count("*").cast("double").alias("n"))
    return pairs.crossJoin(F.broadcast(n)).select("a", "b", r6(graph.name_cosine(F.col("wa"), F.col("wb"), F.col("n"))).alias("cosine"))


@query
def similarity_edges(c: Catalog) -> DataFrame:
    return graph.neighbours(c).select("source", "target", "w", "rank")


@query
def similarity_undirected_edges(c: Catalog) -> DataFrame:
    return graph.edges(graph.neighbours(c))


@query
def similarity_clusters(c: Catalog) -> DataFrame:
    return graph.clusters(c.spark, graph.neighbours(c), c.sets.select("id"))


@query
def overlap_truncate(c: Catalog) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    clips = c.table("events").select("event_id", "user_id", at.alias("start"), (at + F.col("value")).alias("end"))
    return timeline.truncated(clips, "user_id", "start", "end", "event_id").select("event_id", "user_id", F.round("eff_end", 3).alias("eff_end"))


@query
def loop_tiling(c: Catalog) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    notes = c.table("lineitem").select("l_orderkey", "l_linenumber", (n * 4.0).alias("clip_start"), (n * 4.0 + F.col("l_quantity")).alias("clip_end"), F.lit(1.0).alias("loop_start"), (1.0 + p % 8).cast("double").alias("loop_end"), (p % 3 != 0).alias("loop_on"), ((p % 16) / 2).alias("time"))
    return timeline.tiled(notes).select("l_orderkey", "l_linenumber", "beat")


@query
def key_range_join(c: Catalog) -> DataFrame:
    notes = c.table("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("track"), (F.col("o_orderkey") % 128).alias("pitch"))
    parts = c.table("part").select("p_partkey", (F.col("p_partkey") % 50).alias("track"), (F.col("p_size") * 2).alias("low"), (F.col("p_size") * 2 + F.col("p_partkey") % 7).alias("high"))
    return timeline.zones(notes, parts, "track", "pitch", "low", "high").select("o_orderkey", "p_partkey")


@query
def audible_tracks(c: Catalog) -> DataFrame:
    tracks = c.tracks.select("set_id", "idx", (F.col("kind") == "group").alias("mute"), ((F.col("set_id") % 4 == 0) & (F.col("idx") % 3 == 0)).alias("solo"))
    return timeline.audible(tracks).select("set_id", "idx")


@query
def peaks_downsample(c: Catalog) -> DataFrame:
    frames = c.table("events").select((F.col("user_id") % 4).alias("key"), "event_id", (F.col("value") / 500 - 1).alias("v"))
    return timeline.peaks(frames, "key", "event_id", "v", coarse=8, bins=100).select("key", "bin", r6("peak").alias("peak"))


@query
def mix_signals(c: Catalog) -> DataFrame:
    frames = c.table("events").select((F.col("user_id") % 4).alias("key"), (F.col("event_id") % 500).alias("frame"), (F.col("value") - 50).alias("v"))
    return timeline.mixed(frames, "key", "frame", "v").select("key", "frame", r6("value").alias("value"))


@query
def time_signatures(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", kernels.time_signature(F.col("p_partkey") % 495).alias("signature"))
