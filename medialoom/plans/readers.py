"""Queries that read real files (written by plans.fixture) and those of the public operations, with the SQL of each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.adapters import Catalog
from medialoom.functions import names
from medialoom.operators import audio, ingest, matching, search, workflows
from medialoom.operators import catalog as reads
from medialoom.plans import fixture
from medialoom.plans.oracles import normalized, similarity, with_views
from medialoom.plans.registry import query, r6
from medialoom.sources import sets

SQL: dict[str, str] = {}
#: Line items as the fixture numbers them: idx is the track of each in its customer's set.
_LI = """li as (select o_custkey as k, l_orderkey as o, l_linenumber as ln, l_returnflag as flag, l_quantity as qty, p_partkey as pk, p_name, p_brand, p_type, p_size as size, o_orderpriority as prio,
  row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, p_partkey, l_returnflag, l_quantity) - 1 as idx from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey),
 c as (select c_custkey as k, c_name as name, c_mktsegment as segment, c_custkey % 50 = 7 as bad from customer),
 smp as (select li.*, case when pk % 5 = 0 then concat('/lib/', name, ' Project/Samples/Imported/') else concat('/Samples/', p_brand, '/') end || concat(p_name, ' ', cast(pk as varchar), '.wav') as path from li join c using (k) where flag = 'A')"""
_KIND = "case flag when 'A' then 'audio' when 'N' then 'midi' else case when pk % 2 = 1 then 'return' else 'group' end end"


def name_of(path: str = "als_path") -> Column:
    return names.stem(F.col(path)).alias("name")


def flat(column: str, *fields: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",").alias(column)


@query
def set_snapshots(c: Catalog) -> DataFrame:
    rows = sets.snapshots(c.spark, fixture.write_library(c))
    whole = F.array_join(F.transform("tempos", lambda x: x.cast("int").cast("string")), ",").alias("tempos")
    places = F.array_join(F.transform("locators", lambda x: F.concat_ws(":", x["name"], x["time"].cast("int").cast("string"))), ",").alias("locators")
    return rows.select(name_of(), "live_version", "tempo", whole, "time_signature", flat("tracks", "kind", "name", "color"), flat("devices", "track", "kind", "name", "manufacturer"), flat("samples", "path", "in_project"), places, F.array_join("warnings", "; ").alias("warnings"), F.col("error").isNotNull().alias("failed"))


SQL["set_snapshots"] = f"""with {_LI},
 t as (select k, string_agg(concat({_KIND}, ':', p_name, ' ', cast(pk as varchar), ':', cast(size as varchar)), ',' order by idx) as tracks,
   string_agg(concat(cast(idx as varchar), ':', case flag when 'A' then 'native' when 'N' then 'vst3' else 'au' end, ':', p_type, ':', case flag when 'A' then 'Ableton' else p_brand end), ',' order by idx) as devices from li group by k),
 s1 as (select k, path, min(idx) as idx, bool_or(pk % 5 = 0) as own from smp group by k, path),
 s as (select k, string_agg(concat(path, ':', case when own then 'true' else 'false' end), ',' order by idx) as samples from s1 group by k),
 l as (select k, string_agg(concat(prio, ':', cast(o % 512 as varchar)), ',' order by o) as locators from (select distinct k, o, prio from li) group by k)
 select name, case when bad then null else concat('Live 11.', cast(k % 4 as varchar)) end as live_version,
  case when bad or k % 10 = 1 then null else cast(concat(cast(60 + k * 37 % 140 as varchar), '.004') as double) end as tempo,
  case when bad then null when k % 10 = 1 then '' else cast(60 + k * 37 % 140 as varchar) end as tempos,
  case when bad then null else concat(cast(k % 495 % 99 + 1 as varchar), '/', cast(cast(pow(2, k % 495 // 99) as bigint) as varchar)) end as time_signature,
  case when bad then null else coalesce(tracks, '') end as tracks, case when bad then null else coalesce(devices, '') end as devices, case when bad then null else coalesce(samples, '') end as samples, case when bad then null else coalesce(locators, '') end as locators,
  case when bad then null when k % 10 = 0 then 'tempo not found in master-track context; using first occurrence' when k % 10 = 1 then 'tempo not found' else '' end as warnings, bad as failed
 from c left join t using (k) left join s using (k) left join l using (k)"""


@query
def project_tree(c: Catalog) -> DataFrame:
    rows = sets.projects(c.spark, fixture.write_library(c))
    return rows.select("name", F.size("als_files").alias("n_files"), F.array_join(F.transform("backups", lambda b: b["file"]), ",").alias("backups"))


SQL["project_tree"] = "select concat(c_name, ' Project') as name, 1 as n_files, case when c_custkey % 4 = 0 then concat(c_name, ' [2024-01-01 120000].als') else '' end as backups from customer"


@query
def set_hashes(c: Catalog) -> DataFrame:
    """Whether a record's hash and size are those of the file."""
    root = fixture.write_library(c)
    files = sets.set_files(c.spark, root).select("als_path", F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("n"))
    rows = sets.snapshots(c.spark, root).join(files, "als_path").where("error is null")
    return rows.select(name_of(), (F.col("content_hash") == F.col("sha")).alias("same"), (F.col("n") == F.col("file_size")).alias("same_size"))


SQL["set_hashes"] = "select c_name as name, true as same, true as same_size from customer where c_custkey % 50 <> 7"


@query
def set_clips(c: Catalog) -> DataFrame:
    rows = sets.arrangements(c.spark, fixture.write_library(c))
    return rows.select(name_of(), F.explode("clips").alias("x")).select("name", "x.track", "x.start", "x.end", "x.path", "x.disabled")


SQL["set_clips"] = f'with {_LI} select name, cast(idx as int) as track, ln * 4.0::double as start, ln * 4.0::double + qty as "end", path, pk % 7 = 0 as disabled from smp join c using (k) where not bad and pk % 3 <> 0'


@query
def set_notes(c: Catalog) -> DataFrame:
    rows = sets.arrangements(c.spark, fixture.write_library(c)).select(name_of(), "tempo", F.explode("midi_clips").alias("x"))
    return rows.select("name", "tempo", "x.track", "x.start", "x.loop_end", "x.loop_on", F.explode("x.notes").alias("n")).select("name", "tempo", "track", "start", "loop_end", "loop_on", "n.time", "n.duration", "n.key", "n.velocity")


SQL["set_notes"] = f"""with {_LI}, n as (select *, case when pk % 13 = 0 then [1] else [0, 1] end as which from li where flag = 'N'), u as (select *, unnest(which) as w from n)
 select name, case when k % 10 = 1 then 120.0 else cast(concat(cast(60 + k * 37 % 140 as varchar), '.004') as double) end as tempo, cast(idx as int) as track, ln * 4.0::double as start, 4.0::double as loop_end, true as loop_on,
  case w when 0 then pk % 16 / 2.0 else 8.0 end::double as time, case w when 0 then 1.0 else 0.5 end::double as duration, cast(36 + pk % 48 as int) as key, case w when 0 then 60 + size else 100 end as velocity from u join c using (k) where not bad"""


@query
def set_mixers(c: Catalog) -> DataFrame:
    rows = sets.arrangements(c.spark, fixture.write_library(c)).select(name_of(), F.posexplode("tracks").alias("track", "x"))
    return rows.select("name", "track", "x.kind", F.col("x.name").alias("track_name"), "x.mute", "x.solo", "x.vol", names.synth_kind(F.col("x.name")).alias("voice"))


SQL["set_mixers"] = f"""with {_LI} select name, cast(idx as int) as track, {_KIND} as kind, concat(p_name, ' ', cast(pk as varchar)) as track_name, pk % 11 = 0 as mute, pk % 17 = 0 as solo, (1 + size % 4) / 4.0::double as vol, 'tonal' as voice
 from li join c using (k) where not bad"""


@query
def proxy_sets(c: Catalog) -> DataFrame:
    """The samples of sets whose shared samples were moved, read back from the rewritten files."""
    root = fixture.write_library(c)
    whole = sets.set_listing(c.spark, root).select("als_path").where(~F.rlike("als_path", F.lit(_BROKEN)))
    old = sets.sample_paths(sets.with_content(whole, root)).where("path like '/Samples/%'")
    moved = old.groupBy("als_path").agg(F.map_from_entries(F.collect_set(F.struct("path", F.concat(F.lit("/Moved & kept"), F.substring("path", 9, 1 << 20)).alias("new")))).alias("moved"))
    return sets.sample_paths(sets.proxies(sets.with_content(whole.join(moved, "als_path", "left"), root))).select(name_of(), "path")


#: The fixture's cut-off files: keys that leave 7 when divided by 50 end in 07 or 57.
_BROKEN = r"(07|57)\.als$"
SQL["proxy_sets"] = f"with {_LI} select distinct name, case when pk % 5 = 0 then path else concat('/Moved & kept', substr(path, 9)) end as path from smp join c using (k) where not bad"


@query
def wav_peaks(c: Catalog) -> DataFrame:
    files = c.spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(fixture.write_signals(c))
    rows = audio.peaks_of_files(files).select(names.stem(F.col("path")).cast("bigint").alias("user_id"), "seconds", F.posexplode("peaks").alias("bin", "peak"))
    return rows.select("user_id", r6("seconds").alias("seconds"), "bin", "peak")


SQL["wav_peaks"] = f"""with e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, abs(trunc(least(greatest(value / 500 - 1, -1), 1) * 32767)) / 32768.0 as v from events)
 select user_id, round(max(n) * {fixture.EVENT_FRAMES} / {fixture.RATE}.0::double, 6) as seconds, cast(b as int) as bin, round(max(v), 3) as peak from (select *, i * {fixture.EVENT_FRAMES} // 2048 as b, count(*) over (partition by user_id) as n from e) group by user_id, b"""


def _bundles(c: Catalog) -> DataFrame:
    part = c.table("part")
    key = F.col("p_partkey")
    end = F.when(key % 4 == 0, "vst3").when(key % 4 == 1, "component").when(key % 4 == 2, "Clap").otherwise("txt")
    deep = F.when(key % 7 == 0, F.lit("a/b/c/")).when(key % 2 == 0, F.concat("p_brand", F.lit("/"))).otherwise(F.lit(""))
    root = F.when(key % 11 == 0, F.lit("/Applications/Other/")).otherwise(F.lit("/Library/Audio/Plug-Ins/VST3/"))
    return part.select(F.concat(root, deep, "p_name", F.lit(" "), key.cast("string"), F.lit("."), end, F.lit("/Contents/Info.plist")).alias("path"))


@query
def plugin_inventory(c: Catalog) -> DataFrame:
    return sets.plugin_inventory(_bundles(c), ["/Library/Audio/Plug-Ins", "/Applications/Vendor"])


SQL["plugin_inventory"] = f"select distinct {normalized(chr(39).join(['concat(p_name, ', ' ', ', cast(p_partkey as varchar))']))} as norm from part where p_partkey % 4 < 3 and p_partkey % 11 <> 0 and p_partkey % 7 <> 0"


@query
def user_places(c: Catalog) -> DataFrame:
    return sets.user_folders(fixture.preferences(c))


SQL["user_places"] = "select concat('/Users/u', cast(n_nationkey % 7 as varchar), '/Music/lib ', cast(n_nationkey % 5 as varchar)) as path from nation union select concat('/Volumes/disk & ', cast(n_nationkey % 3 as varchar), '/', n_name) from nation"


@query
def search_folders(c: Catalog) -> DataFrame:
    part = c.table("part")
    paths = F.explode(F.array(F.concat(F.lit("/v/"), "p_type"), F.concat(F.lit("/v/"), "p_type", F.lit("/"), "p_brand", F.lit("/")), F.concat(F.lit("/v/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")), F.concat(F.lit("/w/x/"), F.col("p_partkey").cast("string"), F.lit("//"))))
    return sets.planned_roots(part.select(paths.alias("path")), "/w/x/7")


SQL["search_folders"] = "select distinct concat('/v/', p_type, '/', p_brand) as path from part union select concat('/w/x/', cast(p_partkey as varchar)) from part where p_partkey <> 7"


def _audio_listing(c: Catalog) -> DataFrame:
    key = F.col("p_partkey")
    folder = F.when(key % 6 == 0, F.lit("Samples/x/")).when(key % 6 == 1, F.lit(".hidden/")).when(key % 6 == 2, F.concat("p_brand", F.lit("/deep/"))).otherwise(F.lit(""))
    end = F.when(key % 5 == 0, ".WAV").when(key % 5 == 1, ".mp3").when(key % 5 == 2, ".txt").when(key % 5 == 3, ".flac").otherwise(".m4a")
    root = F.when(key % 4 == 0, F.lit("/other/")).otherwise(F.lit("/lib/"))
    return c.table("part").select(F.concat(root, folder, "p_name", F.lit(" "), key.cast("string"), end).alias("path"), (F.col("p_size") * 40_000).cast("long").alias("size"))


_AUDIO = """a as (select p_partkey as key, concat(case when p_partkey % 4 = 0 then '/other/' else '/lib/' end, case p_partkey % 6 when 0 then 'Samples/x/' when 1 then '.hidden/' when 2 then concat(p_brand, '/deep/') else '' end, p_name, ' ', cast(p_partkey as varchar),
  case p_partkey % 5 when 0 then '.WAV' when 1 then '.mp3' when 2 then '.txt' when 3 then '.flac' else '.m4a' end) as path, p_size * 40000 as size from part)"""


@query
def render_files(c: Catalog) -> DataFrame:
    rows = _audio_listing(c)
    shallow = sets.renders(rows, "/lib", 1).select("path", F.lit(True).alias("shallow"))
    return sets.renders(rows, "/lib/").join(shallow, "path", "left").select("path", F.coalesce("shallow", F.lit(False)).alias("shallow"))


SQL["render_files"] = f"with {_AUDIO} select path, key % 6 > 2 as shallow from a where key % 4 <> 0 and key % 6 > 1 and key % 5 <> 2 and size >= case when key % 5 in (1, 4) then 100000 else 1000000 end"


@query
def sample_index(c: Catalog) -> DataFrame:
    return sets.sample_index(_audio_listing(c)).select("path")


SQL["sample_index"] = f"with {_AUDIO} select path from a where key % 6 <> 1 and key % 5 <> 2"


@query
def library_json(c: Catalog) -> DataFrame:
    """The library as JSON documents, and read back from them."""
    rows = ingest.library_json(c.tracks.select("set_id", "idx", "kind", "name"))
    return rows.select("value", F.from_json("value", "set_id bigint, idx int, kind string, name string").alias("x")).select("value", "x.set_id", F.col("x.name").alias("track"))


SQL["library_json"] = with_views("tracks", """select concat('{"set_id":', cast(set_id as varchar), ',"idx":', cast(idx as varchar), ',"kind":"', kind, '","name":"', name, '"}') as value, set_id, name as track from tracks""")


@query
def set_detail_json(c: Catalog) -> DataFrame:
    rows = reads.detail_json(c)
    return rows.select("set_id", F.get_json_object("json", "$.als_path").alias("als_path"), F.size(F.from_json(F.get_json_object("json", "$.tracks"), "array<struct<idx:int>>")).alias("n_tracks"), F.get_json_object("json", "$.n_samples").cast("long").alias("n_samples"))


SQL["set_detail_json"] = with_views("sets tracks", "select id as set_id, als_path, coalesce(cast(n as int), -1) as n_tracks, coalesce(n, 0) as n_samples from sets left join (select set_id, count(*) as n from tracks group by 1) t on t.set_id = sets.id").replace("coalesce(cast(n as int), -1)", "cast(n as int)")


@query
def scan_outcomes(c: Catalog) -> DataFrame:
    """A scan of the library when two thirds of its files are stored as they are."""
    root = fixture.write_library(c)
    files = sets.set_listing(c.spark, root).select("als_path", "file_size", "mtime", F.regexp_extract("als_path", r"#(\d+)\.als$", 1).cast("int").alias("key"))
    return workflows.scan(c.spark, root, files.where("key % 3 <> 0").drop("key")).summary()


SQL["scan_outcomes"] = "select case when c_custkey % 3 <> 0 then 'fresh' when c_custkey % 50 = 7 then 'failed' else 'scanned' end as outcome, count(*) as n from customer group by 1"


@query
def ingest_cascade(c: Catalog) -> DataFrame:
    """Rows of each table by set after a scan: what unreadable files had stays, what the others had is replaced."""
    kept = f"{fixture.folder(c, 'records')}-{uuid.uuid4().hex[:8]}"
    sets.snapshots(c.spark, fixture.write_library(c)).write.parquet(kept)  # parsed once
    records = c.spark.read.parquet(kept)
    new = workflows.children(records)
    old = records.select("als_path")
    stored = {"tracks": old.select("als_path", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"), F.lit("old").alias("kind"), F.lit("x").alias("name"), F.lit(1).alias("color")), "locators": old.select("als_path", F.lit(0).alias("idx"), F.lit("old").alias("name"), F.lit(0.0).alias("time"))}
    after = workflows.replace_sets(stored, records)
    counts = [t.groupBy("als_path").agg(F.count("*").alias("n"), F.count_if(F.col("name").isin("old", "x")).alias("n_old")).select(name_of(), F.lit(k).alias("kind"), "n", "n_old") for k, t in after.items()]
    assert set(new) == {"sets", "tracks", "devices", "samples", "locators"}
    return counts[0].union(counts[1])


SQL["ingest_cascade"] = f"""with {_LI} select name, 'tracks' as kind, case when bad then 3 else count(*) end as n, case when bad then 3 else 0 end as n_old from c left join li using (k) group by name, bad, c.k having bad or count(li.o) > 0
 union all select name, 'locators', case when bad then 1 else count(distinct o) end, case when bad then 1 else 0 end from c left join li using (k) group by name, bad, c.k having bad or count(li.o) > 0"""


@query
def replace_backups(c: Catalog) -> DataFrame:
    rows = sets.projects(c.spark, fixture.write_library(c))
    stored = rows.select("dir", F.lit("old.als").alias("file"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    after = workflows.replace_backups(stored, rows.where(F.col("name").rlike("[02468] Project$")))
    return after.select(names.basename(F.col("dir")).alias("project"), "file")


SQL["replace_backups"] = "select concat(c_name, ' Project') as project, case when c_custkey % 2 = 0 then concat(c_name, ' [2024-01-01 120000].als') else 'old.als' end as file from customer where c_custkey % 2 = 1 or c_custkey % 4 = 0"


@query
def attach_previews(c: Catalog) -> DataFrame:
    """Previews after one was attached to every third set, at full confidence; some of them under a path that is there."""
    have = c.previews.select("set_id", "audio_path", "confidence", "mtime")
    new = have.where("set_id % 3 = 0").groupBy("set_id").agg(F.min("audio_path").alias("audio_path"), F.max("mtime").alias("mtime")).select("set_id", F.when(F.col("set_id") % 2 == 0, F.col("audio_path")).otherwise(F.lit("/new.wav")).alias("audio_path"), F.lit(1.0).alias("confidence"), "mtime")
    return workflows.attach(have, new).select("set_id", "audio_path", "confidence", "primary")


SQL["attach_previews"] = with_views("previews", """, n as (select set_id, case when set_id % 2 = 0 then min(audio_path) else '/new.wav' end as audio_path, 1.0::double as confidence, max(mtime) as mtime from previews where set_id % 3 = 0 group by set_id),
 a as (select set_id, audio_path, confidence, mtime from previews p where not exists (select 1 from n where n.set_id = p.set_id and n.audio_path = p.audio_path) union all select * from n)
 select set_id, audio_path, confidence, row_number() over (partition by set_id order by confidence desc, mtime desc, audio_path) = 1 as "primary" from a""").replace(") , n as", "), n as")


def _library(c: Catalog) -> DataFrame:
    return c.sets.join(c.projects.select(F.col("id").alias("project_id"), F.concat("name", F.lit(" Project")).alias("project")), "project_id").select(F.col("id").alias("set_id"), "project_id", "als_path", "project")


def _renders(c: Catalog) -> DataFrame:
    """A render for most sets: named after the set, after the project, or after nothing; a few are known samples."""
    key = F.col("id")
    label = F.when(key % 4 == 0, F.concat(F.lit("set "), key.cast("string"), F.lit(" v2 FINAL"))).when(key % 4 == 1, F.concat(F.lit("set "), key.cast("string"), F.lit(" extra [x]"))).when(key % 4 == 2, F.concat("name", F.lit("_master"))).otherwise(F.concat(F.lit("qq zz "), key.cast("string")))
    rows = c.sets.where("id % 10 <> 9").select("id", "project_id", "mtime").join(c.projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    return rows.select(F.concat(F.lit("/out/"), key.cast("string"), F.lit("/"), label, F.lit(".wav")).alias("path"), (key * 10).alias("size"), "mtime", "project_id", F.col("id").alias("of"))


def _known(c: Catalog) -> DataFrame:
    return _renders(c).where("of % 13 = 0").select(F.upper("path").alias("path"))


def _stored_previews(c: Catalog) -> DataFrame:
    """What is stored: of every fifth set the very render, of every seventh a better one, of every eleventh a worse one."""
    r = _renders(c).where("of % 4 = 0")
    rows = r.select(F.col("of").alias("set_id"), "path", "size", "mtime")
    same = rows.where("set_id % 5 = 0").select("set_id", F.col("path").alias("audio_path"), "size", "mtime", F.lit(0.5).alias("confidence"))
    better = rows.where("set_id % 7 = 0").select("set_id", F.lit("/b.wav").alias("audio_path"), "size", F.expr("mtime + interval 1 day").alias("mtime"), F.lit(1.0).alias("confidence"))
    worse = rows.where("set_id % 11 = 0").select("set_id", F.lit("/w.wav").alias("audio_path"), "size", "mtime", F.lit(0.3).alias("confidence"))
    return same.union(better).union(worse)


_RENDERS = f"""r0 as (select s.id as of, s.project_id, s.mtime, p.name as pname, concat('/out/', cast(s.id as varchar), '/', case s.id % 4 when 0 then concat('set ', cast(s.id as varchar), ' v2 FINAL') when 1 then concat('set ', cast(s.id as varchar), ' extra [x]') when 2 then concat(p.name, '_master') else concat('qq zz ', cast(s.id as varchar)) end) as label
   from sets s join projects p on p.id = s.project_id where s.id % 10 <> 9),
 r as materialized (select of, project_id, mtime, concat(label, '.wav') as path, {normalized("list_extract(string_split(label, '/'), -1)")} as norm from r0 where of % 13 <> 0),
 cand as materialized (select s.id, s.project_id, {normalized("concat('set ', cast(s.id as varchar))")} as stem, {normalized("p.name")} as title, count(*) over (partition by s.project_id) as n from sets s join projects p on p.id = s.project_id),
 st as (select of as set_id, concat(label, '.wav') as audio_path, mtime, 0.5::double as confidence, true as same from r0 where of % 4 = 0 and of % 5 = 0 union all select of, '/b.wav', mtime + interval 1 day, 1.0, false from r0 where of % 4 = 0 and of % 7 = 0 union all select of, '/w.wav', mtime, 0.3, false from r0 where of % 4 = 0 and of % 11 = 0),
 top as (select set_id, max(confidence) as tc, arg_max(mtime, {{'c': confidence, 'm': mtime}}) as tm from st group by set_id)"""
_TARGETS = """b as (select * from f qualify row_number() over (partition by set_id, project_id order by confidence desc, mtime desc, path) = 1),
 o as (select b.set_id, b.project_id, b.path, b.confidence, case when exists (select 1 from st where st.set_id is not distinct from b.set_id and lower(st.audio_path) = lower(b.path) and st.mtime = b.mtime and st.same) then 'unchanged' when top.tc is not null and (b.confidence < tc or (b.confidence = tc and b.mtime <= tm)) then 'worse' else 'matched' end as outcome from b left join top on top.set_id = b.set_id)"""


@query
def harvest_folders(c: Catalog) -> DataFrame:
    rows = workflows.harvest(_renders(c).drop("of"), _library(c), _known(c), _stored_previews(c))
    return rows.select("set_id", "project_id", "path", r6("confidence").alias("confidence"), "outcome")


SQL["harvest_folders"] = with_views("projects sets", f""", {_RENDERS},
 pr as (select r.*, cand.id, cand.n, {similarity('norm', 'stem')} as s, {similarity('norm', 'title')} as p from r join cand using (project_id)),
 m as (select of, project_id, mtime, path, max(n) as n, min(id) as sole, max(case when s >= 0.6 then s end) as s, arg_max(case when s >= 0.6 then id end, {{'s': case when s >= 0.6 then s end, 'i': -id}}) filter (s >= 0.6) as hit, max(case when p >= 0.6 then p end) as p from pr group by all),
 f as (select case when hit is not null then hit when n = 1 then sole end as set_id, project_id, path, mtime, case when hit is not null then least(s + 0.05, 1.0) when p is not null then case when n = 1 then least(p * 0.9 + 0.05, 1.0) else p * 0.5 end when n = 1 then 0.7 end as confidence from m), fx as (select * from f where confidence is not null),
 {_TARGETS.replace('from f qualify', 'from fx qualify')} select set_id, project_id, path, round(confidence, 6) as confidence, outcome from o""").replace(") , r0", "), r0")


@query
def hunt_outcomes(c: Catalog) -> DataFrame:
    return workflows.hunt(_renders(c).drop("of"), _library(c), _known(c), _stored_previews(c))[1]


SQL["hunt_outcomes"] = with_views("projects sets", f""", {_RENDERS}, words as (select id, unnest(string_split(stem, ' ')) as w from cand), pwords as (select distinct project_id, title, n, unnest(string_split(title, ' ')) as w from cand),
 rw as (select of, unnest(string_split(norm, ' ')) as w from r),
 ps as (select distinct rw.of, words.id from rw join words on words.w = rw.w and rw.w <> 'set'),
 s as (select r.of, cand.id, cand.project_id, {similarity('norm', 'stem')} as s from ps join r on r.of = ps.of join cand on cand.id = ps.id),
 sb as (select * from s where s >= 0.6 qualify row_number() over (partition by of order by s desc, id) = 1),
 pp as (select distinct rw.of, pwords.project_id, title, n from rw join pwords on pwords.w = rw.w and rw.w <> 'customer'),
 p as (select r.of, pp.project_id, pp.n, {similarity('norm', 'title')} as p from pp join r on r.of = pp.of), pb as (select * from p where p >= 0.6 qualify row_number() over (partition by of order by p desc, project_id) = 1),
 f as (select r.path, r.mtime, coalesce(sb.id, case when pb.n = 1 then (select min(id) from cand where cand.project_id = pb.project_id) end) as set_id, coalesce(sb.project_id, pb.project_id) as project_id, coalesce(sb.s, case when pb.n = 1 then pb.p * 0.9 else pb.p * 0.5 end) as confidence from r left join sb on sb.of = r.of left join pb on pb.of = r.of where sb.id is not null or pb.project_id is not null),
 {_TARGETS}, e as (select 'samples_skipped' as outcome from r0 where of % 13 = 0 union all select 'unmatched' from r where path not in (select path from f) union all select 'ambiguous' from f where set_id is null union all select outcome from o) select outcome, count(*) as n from e group by 1""").replace(") , r0", "), r0")


@query
def watch_suggestions(c: Catalog) -> DataFrame:
    """Suggestions of two sources for the sets, without samples, ignored pairs and what is attached."""
    rows = c.previews.select("set_id", "id", "confidence", "audio_path").join(c.sets.select(F.col("id").alias("set_id"), "project_id"), "set_id")
    source = lambda r, step: r.select("set_id", "project_id", F.when(F.col("id") % 4 == 0, F.upper("audio_path")).otherwise(F.col("audio_path")).alias("path"), (F.col("confidence") * step).alias("confidence"))
    a, b = source(rows.where("id % 2 = 0"), 0.5), source(rows.where("id % 3 = 0"), 1.0)
    known, ignored, attached = rows.where("id % 5 = 0").select(F.col("audio_path").alias("path")), rows.where("id % 7 = 0").select("set_id", "audio_path"), rows.where("id % 11 = 0").select("set_id", F.upper("audio_path").alias("audio_path"))
    found = matching.suggestions([a, b], known, ignored, attached, c.sets.where("id % 2 = 0").select("project_id"))
    return found.select("set_id", "project_id", "path", r6("confidence").alias("confidence"), "has_preview")


SQL["watch_suggestions"] = with_views("previews sets", """, x as (select p.id, p.set_id, s.project_id, case when p.id % 4 = 0 then upper(p.audio_path) else p.audio_path end as path, p.confidence from previews p join sets s on s.id = p.set_id where p.id % 5 <> 0 and p.id % 7 <> 0 and p.id % 11 <> 0)
 select set_id, project_id, path, round(case when id % 2 = 0 then confidence * 0.5 else confidence end, 6) as confidence, project_id in (select project_id from sets where id % 2 = 0) as has_preview from x where id % 2 = 0 or id % 3 = 0""").replace(") , x", "), x")


@query
def resolve_references(c: Catalog) -> DataFrame:
    words = ["12", "-3", "/lib/5-LOW/set 0.als", "set 77", "HIGH/set 1", "no such set", "2-HIGH"]
    return workflows.resolve(c.sets, c.spark.createDataFrame([(w,) for w in words], "ref string"))


SQL["resolve_references"] = with_views("sets", ", q as (select unnest(['12', '-3', '/lib/5-LOW/set 0.als', 'set 77', 'HIGH/set 1', 'no such set', '2-HIGH']) as ref) select ref, coalesce(try_cast(ref as bigint), (select id from sets where contains(als_path, ref) order by als_path <> ref, id limit 1)) as id from q").replace(") , q", "), q")


@query
def list_management(c: Catalog) -> DataFrame:
    """Lists after some were asked for (most are there in another case), one was renamed and one deleted with what it held."""
    lists = workflows.create_list(c.lists, c.table("nation").where("n_nationkey < 3").select(F.concat(F.lit("to "), "n_name").alias("name")).union(c.lists.select(F.lower("name"))))
    lists = workflows.rename_list(lists, c.lists.where("id = 2").select("id", F.lit("Favourites").alias("name")))
    lists, items = workflows.delete_list(lists, c.list_items, c.lists.where("id = 1").select("id"))
    counts = items.groupBy(F.col("list_id").alias("id")).agg(F.count("*").alias("n_items"))
    return lists.join(counts, "id", "left").select("id", "name", F.coalesce("n_items", F.lit(0)).alias("n_items"))


SQL["list_management"] = with_views("lists list_items", ", n as (select (select max(id) from lists) + row_number() over (order by lower(n_name)) as id, concat('to ', n_name) as name from nation where n_nationkey < 3), a as (select id, case when id = 2 then 'Favourites' else name end as name from lists where id <> 1 union all select * from n) select id, name, (select count(*) from list_items i where i.list_id = a.id) as n_items from a").replace(") , n", "), n")


@query
def reindex_artists(c: Catalog) -> DataFrame:
    by_path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/lib/artists/someone "), (F.col("id") % 9).cast("string"), F.lit("/"), "name")).otherwise(F.concat(F.lit("/lib/2024/"), "name"))
    return workflows.reindexed_artists(c.projects.withColumn("folder_path", by_path), "/lib").select("id", "artist")


SQL["reindex_artists"] = with_views("projects", "select id, case when id % 3 = 0 then concat('someone ', cast(id % 9 as varchar)) else artist end as artist from projects")


@query
def stale_exports(c: Catalog) -> DataFrame:
    """Sets whose preview is not newer than their file, with the key under which a sketch of each is kept."""
    inputs = c.sets.select(F.col("id").alias("key"), "mtime")
    made = inputs.where("key % 4 <> 0").select("key", F.when(F.col("key") % 3 == 0, F.expr("mtime - interval 1 hour")).otherwise(F.col("mtime")).alias("mtime"))
    rows = workflows.stale_outputs(made, inputs).join(c.sets.select(F.col("id").alias("key"), "als_path", "mtime"), "key")
    return rows.select("key", workflows.sketch_key(F.col("als_path"), F.col("mtime").cast("timestamp")).alias("sketch"))


SQL["stale_exports"] = with_views("sets", "select id as key, sha256(concat(als_path, '|', cast(epoch_us(mtime) as varchar))) as sketch from sets where id % 4 = 0 or id % 3 = 0")


def _missing(c: Catalog) -> DataFrame:
    gone = c.samples.select("set_id", "path").distinct().where(F.regexp_extract("path", r" (\d+)\.wav$", 1).cast("int") % 3 == 2)
    return gone.join(c.sets.select(F.col("id").alias("set_id"), F.concat(F.lit("/lib/p"), F.col("project_id").cast("string")).alias("project_dir")), "set_id").select("set_id", "project_dir", "path")


def _found(c: Catalog) -> DataFrame:
    """What exists: all samples of even brands in one other folder, those of other brands here and there, and some by another name."""
    key, brand = F.col("p_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    file = F.concat("p_name", F.lit(" "), key.cast("string"))
    path = F.when(brand % 2 == 0, F.concat(F.lit("/Moved/"), "p_brand", F.lit("/"), file, F.lit(".wav"))).when(key % 5 == 0, F.concat(F.lit("/Other/"), key.cast("string"), F.lit("/"), file, F.lit(".wav"))).when(key % 5 == 1, F.concat(F.lit("/Third/"), key.cast("string"), F.lit("/"), file, F.lit(".aif")))
    return c.table("part").where("p_partkey % 3 = 2").select(path.alias("path"), F.col("p_size").cast("long").alias("mtime")).where("path is not null")


@query
def relink_plan(c: Catalog) -> DataFrame:
    known = _found(c).where("mtime % 2 = 0").select("path").union(c.samples.select("path"))
    return workflows.relink_plan(_missing(c), _found(c), known)


SQL["relink_plan"] = with_views("samples sets", """, h as (select p_partkey as key, p_name, p_brand, p_size, concat(p_name, ' ', cast(p_partkey as varchar)) as file, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 2 = 0 as even from part where p_partkey % 3 = 2),
 e as (select *, case when even then concat('/Moved/', p_brand, '/', file, '.wav') when key % 5 = 0 then concat('/Other/', cast(key as varchar), '/', file, '.wav') when key % 5 = 1 then concat('/Third/', cast(key as varchar), '/', file, '.aif') end as path from h),
 m as (select distinct s.set_id, s.path, e.key, e.even, e.p_brand, e.p_size, e.path as found, e.key % 5 as k5 from samples s join e on s.path = concat('/Samples/', e.p_brand, '/', e.file, '.wav')),
 g as (select set_id, p_brand, count(*) as n, count(*) filter (p_size % 2 = 0) as spoken, count(*) filter (even or k5 = 0) as there from m group by all),
 o as (select m.*, g.n, g.spoken, g.there, case when g.there = g.n and (even or g.n = 1) then case when g.spoken = g.n then 1 else 2 end when k5 = 0 and p_size % 2 = 0 then 4 when k5 in (0, 1) then 5 end as stage from m join g using (set_id, p_brand)),
 f as materialized (select path, p_size, __norm_file__ as hn from e where path is not null),
 w as materialized (select distinct path, __norm_path__ as wn from o where stage is null),
 z as materialized (select w.path, f.path as found from w, f where replace(hn, ' ', '') = replace(wn, ' ', '') or (length(replace(wn, ' ', '')) >= 6 and (contains(replace(hn, ' ', ''), replace(wn, ' ', '')) or contains(replace(wn, ' ', ''), replace(hn, ' ', '')))) or __similar__ >= 0.75
   qualify row_number() over (partition by w.path order by p_size desc, f.path) = 1)
 select set_id, o.path, case when stage is null then z.found else o.found end as found, case when stage is null and z.found is not null then 5 else stage end as stage from o left join z on z.path = o.path""").replace(") , h", "), h")
SQL["relink_plan"] = SQL["relink_plan"].replace("__norm_file__", normalized("file")).replace("__norm_path__", normalized("regexp_extract(path, '([^/]*)\\.wav$', 1)")).replace("__similar__", similarity("wn", "hn"))


@query
def search_text(c: Catalog) -> DataFrame:
    want = search.Search(text="small 7", min_bpm=90, sort_by=None)
    return search.search(c, want).select("set_id", "project", "artist", "tempo", r6("score").alias("score"))


def _search_text() -> str:
    from medialoom.plans.oracles import bm25

    index = """select s.id as set_id, p.name as project_name, concat('set ', cast(s.id as varchar)) as set_name,
      (select string_agg(name, ' ') from tracks t where t.set_id = s.id) as track_names, (select string_agg(name, ' ') from devices v where v.set_id = s.id) as device_names,
      (select string_agg(list_extract(string_split(path, '/'), -1), ' ') from samples m where m.set_id = s.id) as sample_names from sets s join projects p on p.id = s.project_id"""
    ranked = bm25("set_id", search.FIELD_WEIGHTS, index, ["small", "7"])
    cut = ranked.rindex(" select set_id, round")
    return with_views("projects sets tracks devices samples", f", {ranked[:cut]}, ranked as ({ranked[cut:]}) select s.id as set_id, p.name as project, coalesce(s.artist_override, p.artist) as artist, s.tempo, score from ranked join sets s on s.id = ranked.set_id join projects p on p.id = s.project_id where s.tempo >= 90").replace(") , d as", "), d as")


SQL["search_text"] = _search_text()


@query
def search_scanned(c: Catalog) -> DataFrame:
    now = c.projects.agg(F.max("last_scanned")).first()[0]
    return search.search(c, search.Search(scanned="week", now=now, sort_by="modified")).select("set_id", "project", "tempo")


SQL["search_scanned"] = with_views("projects sets", "select s.id as set_id, p.name as project, tempo from sets s join projects p on p.id = s.project_id where s.project_id % 28 <= 7")


@query
def orphan_projects(c: Catalog) -> DataFrame:
    return ingest.orphan_projects(c.projects, c.sets.where("project_id % 4 <> 0")).select("id", "name")


SQL["orphan_projects"] = with_views("projects sets", "select id, name from projects p where not exists (select 1 from sets s where s.project_id = p.id and s.project_id % 4 <> 0)")


@query
def prune_previews(c: Catalog) -> DataFrame:
    listing = c.previews.where("id % 3 <> 0").select(F.upper("audio_path").alias("path"))
    return ingest.prune_previews(c.previews, listing).select("id", "set_id")


SQL["prune_previews"] = with_views("previews", "select id, set_id from previews where id % 3 <> 0")


@query
def fresh_previews(c: Catalog) -> DataFrame:
    rows = c.previews.select(F.when(F.col("id") % 5 != 0, F.col("set_id")).alias("set_id"), "audio_path", F.col("id").alias("size"), "mtime")
    stored = rows.where("size % 4 <> 0").select("set_id", F.upper("audio_path").alias("audio_path"), F.when(F.col("size") % 7 == 0, 0).otherwise(F.col("size")).alias("size"), "mtime")
    return ingest.fresh_previews(rows, stored).select("set_id", "size")


SQL["fresh_previews"] = with_views("previews", "select case when id % 5 <> 0 then set_id end as set_id, id as size from previews where id % 4 = 0 or (id % 7 = 0 and id <> 0)")


@query
def resolved_samples(c: Catalog) -> DataFrame:
    """Where each sample of a set is: at its path, in the project's Samples folder, or where an index has its name."""
    rows = c.samples.join(c.sets.select(F.col("id").alias("set_id"), F.concat(F.lit("/p"), (F.col("project_id") % 3).cast("string")).alias("project_dir")), "set_id").select("set_id", "project_dir", "path")
    part = c.table("part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("file"), "p_brand")
    listing = part.where("k % 4 = 0").select(F.concat(F.lit("/Samples/"), "p_brand", F.lit("/"), "file").alias("path")).union(part.where("k % 4 = 1").select(F.concat(F.lit("/p1/Samples/"), "file")))
    index = part.where("k % 4 = 1 or k % 4 = 2").select(F.upper("file").alias("name"), F.concat(F.lit("/idx/"), "file").alias("path"))
    return matching.resolved_samples(rows, listing, index).select("set_id", "path", "found")


SQL["resolved_samples"] = """select l_orderkey as set_id, concat('/Samples/', p_brand, '/', p_name, ' ', cast(p_partkey as varchar), '.wav') as path,
 case when p_partkey % 4 = 0 then concat('/Samples/', p_brand, '/', p_name, ' ', cast(p_partkey as varchar), '.wav') when p_partkey % 4 = 1 and o_custkey % 3 = 1 then concat('/p1/Samples/', p_name, ' ', cast(p_partkey as varchar), '.wav')
  when p_partkey % 4 < 3 then concat('/idx/', p_name, ' ', cast(p_partkey as varchar), '.wav') end as found from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey"""


@query
def sample_paths_by_basename(c: Catalog) -> DataFrame:
    wanted = c.table("part").where("p_partkey % 6 = 0").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("name"))
    return matching.paths_by_basename(c.samples, wanted)


SQL["sample_paths_by_basename"] = with_views("samples", "select distinct list_extract(string_split(path, '/'), -1) as name, path from samples where cast(regexp_extract(path, ' ([0-9]+)\\.wav', 1) as int) % 6 = 0")


@query
def blank_names(c: Catalog) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).when(F.col("n_nationkey") % 3 == 1, F.lit("   "))
    return c.table("nation").select("n_nationkey", names.blank_to_null(raw).alias("name"))


SQL["blank_names"] = "select n_nationkey, case when n_nationkey % 3 = 0 then n_name end as name from nation"


@query
def triage_jobs(c: Catalog) -> DataFrame:
    """Pending jobs scored by how well their sets can be rendered."""
    part = c.table("part")
    inventory = part.where("p_type not in ('PROMO', 'SMALL')").select(F.explode(F.array(names.normalize(F.col("p_type")), names.normalize(F.concat("p_brand", F.lit(" kit"))))).alias("norm")).distinct()
    scores = matching.render_scores(c.sets, c.devices, c.samples.select("set_id", F.lit("present").alias("state")), inventory)
    return reads.triaged(c.export_jobs, scores).select("id", "status", r6("score").alias("score"))


SQL["triage_jobs"] = with_views("sets devices export_jobs", """, pl as (select set_id, count(distinct name) filter (name in ('PROMO', 'SMALL')) as m from devices where kind <> 'native' group by set_id)
 select j.id, j.status, round(case when j.status = 'pending' and s.id is not null then 1.0::double - least(0.12::double * coalesce(pl.m, 0), 0.6) else j.score end, 6) as score from export_jobs j left join sets s on s.id = j.set_id left join pl on pl.set_id = j.set_id""").replace(") , pl", "), pl")


@query
def graph_nodes(c: Catalog) -> DataFrame:
    """The nodes of the similarity graph but for their clusters."""
    from medialoom.operators import graph

    return graph.nodes(c).select("id", "name", "tempo", "artist", "has_preview", "n_samples", "n_devices")


SQL["graph_nodes"] = with_views("projects sets devices samples previews", """select s.id, concat('set ', cast(s.id as varchar)) as name, s.tempo, lower(coalesce(nullif(s.artist_override, ''), nullif(p.artist, ''), '')) as artist,
 exists (select 1 from previews v where v.set_id = s.id and v.source <> 'sketch') as has_preview, cast((select count(distinct lower(list_extract(string_split(path, '/'), -1))) from samples m where m.set_id = s.id) as int) as n_samples,
 cast((select count(distinct lower(manufacturer) || ':' || lower(name)) from devices d where d.set_id = s.id) as int) as n_devices from sets s join projects p on p.id = s.project_id""")
