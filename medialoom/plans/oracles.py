"""The SQL that each catalog query is held against, over the raw tables."""

from __future__ import annotations

VIEWS = {
    "projects": """select c_custkey as id, concat('/lib/', c_mktsegment, '/', c_name) as folder_path, c_name as name,
        case when c_custkey % 5 = 0 then null else n_name end as artist from customer join nation on n_nationkey = c_nationkey""",
    "sets": """select o_orderkey as id, o_custkey as project_id, concat('/lib/', o_orderpriority, '/set ', cast(o_orderkey as varchar), '.als') as als_path,
        case when o_orderkey % 17 = 0 then null else cast(60 + (o_orderkey * 37) % 140 as double) end as tempo, o_orderdate as mtime,
        case when o_orderkey % 11 = 0 then o_orderpriority else null end as artist_override from orders""",
    "tracks": """select l_orderkey as set_id, l_linenumber as idx, case when l_returnflag = 'A' then 'audio' when l_returnflag = 'N' then 'midi' else 'group' end as kind,
        concat(p_name, ' ', cast(p_partkey as varchar)) as name from lineitem join part on p_partkey = l_partkey""",
    "devices": """select l_orderkey as set_id, p_type as name, p_brand as manufacturer, case when l_returnflag = 'A' then 'native' else 'vst3' end as kind
        from lineitem join part on p_partkey = l_partkey""",
    "samples": """select l_orderkey as set_id, concat('/Samples/', p_brand, '/', p_name, ' ', cast(p_partkey as varchar), '.wav') as path
        from lineitem join part on p_partkey = l_partkey""",
    "previews": """select event_id as id, cast(floor(event_id / 3.0) as bigint) as set_id, case when event_id % 40 = 0 then event_id % 100 end as project_id, concat('/r/', cast(event_id as varchar), '.wav') as audio_path,
        case when event_type = 'error' then 'sketch' else 'discovered' end as source, value / 1000.0 as confidence, ts as mtime from events""",
    "export_jobs": """select event_id as id, event_id as set_id, case when event_id % 4 = 0 then 'pending' when event_id % 4 = 1 then 'processing'
        when event_id % 4 = 2 then 'completed' else 'failed' end as status, case when event_id % 3 = 0 then null else value / 1000.0 end as score, ts as created_at from events""",
    "lists": "select cast(r_regionkey as bigint) as id, r_name as name from region",
    "list_items": "select o_orderkey % 5 as list_id, concat('/lib/', o_orderpriority, '/set ', cast(o_orderkey as varchar), '.als') as als_path from orders where o_orderkey % 7 = 0",
    "best": """select * from (select *, row_number() over (partition by set_id order by confidence desc, mtime desc, id) as n
        from (select event_id as id, cast(floor(event_id / 3.0) as bigint) as set_id, concat('/r/', cast(event_id as varchar), '.wav') as audio_path,
        case when event_type = 'error' then 'sketch' else 'discovered' end as source, value / 1000.0 as confidence, ts as mtime from events)) where n = 1""",
    "hits": """select s.id as set_id, p.name as project, coalesce(s.artist_override, p.artist) as artist, s.als_path, s.tempo, s.mtime, b.audio_path is not null as has_preview,
        b.source as preview_source, exists (select 1 from list_items l where l.als_path = s.als_path) as in_list
        from sets s join projects p on p.id = s.project_id left join best b on b.set_id = s.id""",
    "files": """select concat('/Samples/', p_brand, '/', case when p_partkey % 3 = 0 then '' else '.' end, p_name, ' ', cast(p_partkey as varchar), '.wav', case when p_partkey % 3 = 0 then '' else '.icloud' end) as path,
        concat('/Samples/', p_brand, '/', p_name, ' ', cast(p_partkey as varchar), '.wav') as of, p_partkey % 3 as k from part where p_partkey % 3 < 2""",
    "states": "select s.set_id, s.path, case when f.k = 0 then 'present' when f.k = 1 then 'evicted' else 'missing' end as state from samples s left join files f on f.of = s.path",
    "stored": "select als_path, id, case when id % 7 = 1 then id + 1 else id end as file_size, mtime from sets where id % 10 <> 3",
}

_STOP = "('final','finals','master','mastered','mix','mixdown','bounce','bounced','export','exported','render','demo','rough','draft','edit','full','song','track','new','old','copy')"
_GRAPH_STOP = "('the','and','for','set','als','ableton','project','live','copy','final','new','untitled','version','wav','mix','master')"


def normalized(name: str) -> str:
    """SQL for a name in comparable form, for ASCII names whose brackets are not nested."""
    words = f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({name}), '\\[[^\\]]*\\]', '', 'g'), '[^a-z0-9]+'), lambda x: x <> '' and x not in {_STOP} and not regexp_full_match(x, 'v[0-9]+')), ' ')"
    return f"regexp_replace(regexp_replace({words}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"


def similarity(a: str, b: str) -> str:
    wa, wb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    both = f"len(list_intersect({wa}, {wb}))"
    return f"case when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 when starts_with({a}, {b} || ' ') or starts_with({b}, {a} || ' ') then 0.85 else {both} / cast(len({wa}) + len({wb}) - {both} as double) end"


def kernel(a: str, b: str) -> str:
    bell = lambda r: f"exp(-pow({a} - {b} * {r}, 2) / 128.0)"
    return f"case when {a} is null or {b} is null then 0.0 else greatest({bell('1.0')}, {bell('2.0')}, {bell('0.5')}) end"


def graph_words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: length(x) >= 2 and x not in {_GRAPH_STOP}))"


def with_views(names: str, rest: str) -> str:
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names.split()) + " " + rest


def bm25(key: str, fields: dict[str, float], source: str, query: list[str]) -> str:
    """SQL for the ranking, from words unnested to rows."""
    parts = " union all ".join(f"select {key}, {w} as weight, unnest(list_filter(string_split_regex(translate(lower(coalesce({f}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as t from d" for f, w in fields.items())
    out = f"d as ({source}), t as ({parts}), l as (select {key}, count(*) as n from t group by {key}), every as (select d.{key}, coalesce(l.n, 0) as length from d left join l using ({key})), a as (select count(*) as n, avg(length) as mean from every)"
    for k, q in enumerate(query):
        out += f", q{k} as (select {key}, sum(weight) as f from t where starts_with(t, '{q}') group by {key}), n{k} as (select count(*) as c from q{k})"
    idf = lambda k: f"(case when ln((a.n - n{k}.c + 0.5) / (n{k}.c + 0.5)) <= 0 then 1e-6 else ln((a.n - n{k}.c + 0.5) / (n{k}.c + 0.5)) end)"
    score = " + ".join(f"{idf(k)} * q{k}.f * 2.2 / (q{k}.f + 1.2 * (0.25 + 0.75 * every.length / a.mean))" for k in range(len(query)))
    joins = " ".join(f"join q{k} using ({key}) cross join n{k}" for k in range(len(query)))
    return f"{out} select {key}, round(-({score}), 6) as score from every {joins} cross join a"


_FEATURES = f"""
 s0 as materialized (select s.id, s.tempo, lower(coalesce(nullif(s.artist_override, ''), nullif(p.artist, ''), '')) as artist, s.project_id, concat('set ', cast(s.id as varchar)) as stem from sets s join projects p on p.id = s.project_id),
 fs as (select distinct set_id as id, lower(list_extract(string_split(path, '/'), -1)) as k from samples),
 fd as (select distinct set_id as id, lower(manufacturer) || ':' || lower(name) as k from devices),
 fw0 as materialized (select distinct id, k from (select set_id as id, unnest({graph_words('name')}) as k from tracks union all select id, unnest({graph_words('stem')}) from s0)),
 df as materialized (select k, count(*) as df from fw0 group by k having count(*) <= 60),
 fw as materialized (select id, fw0.k, ln((1.0 + (select count(*) from s0)) / (1.0 + df)) + 1 as idf from fw0 join df on df.k = fw0.k),
 nw as materialized (select id, greatest(sqrt(sum(idf * idf)), 1e-6) as norm from fw group by id)"""

_GRAPH = f"""{_FEATURES},
 keys as (select id, 's' || k as k from fs union all select id, 'd' || k from fd union all select id, 'w' || k from fw union all select id, 'a' || artist from s0 where artist <> '' union all select id, 'p' || cast(project_id as varchar) from s0),
 few as (select k from keys group by k having count(*) >= 2),
 o as (select id, row_number() over (order by tempo asc nulls last, id) as pos from s0),
 pairs as materialized (select distinct a, b from (select x.id as a, y.id as b from keys x join few using (k) join keys y using (k) where x.id <> y.id
   union all select x.id, y.id from o x join o y on y.pos between x.pos - 12 and x.pos + 12 where x.id <> y.id)),
 is_ as (select x.id as a, y.id as b, count(*) as n from fs x join fs y using (k) join pairs on pairs.a = x.id and pairs.b = y.id group by all),
 id_ as (select x.id as a, y.id as b, count(*) as n from fd x join fd y using (k) join pairs on pairs.a = x.id and pairs.b = y.id group by all),
 iw as (select x.id as a, y.id as b, sum(x.idf * y.idf) as dot from fw x join fw y using (k) where x.id <> y.id group by all),
 ns as (select id, count(*) as n from fs group by id), nd as (select id, count(*) as n from fd group by id),
 w as (select p.a as source, p.b as target, round(
   0.20 * coalesce(is_.n / cast(sa.n + sb.n - is_.n as double), 0) + 0.03 * coalesce(id_.n / cast(da.n + db.n - id_.n as double), 0)
   + 0.20 * case when x.artist <> '' and x.artist = y.artist then 1.0 when x.project_id = y.project_id then 0.5 else 0.0 end
   + 0.07 * coalesce(iw.dot / (wa.norm * wb.norm), 0) + 0.10 * ({kernel('x.tempo', 'y.tempo')}), 6) as w
   from pairs p join s0 x on x.id = p.a join s0 y on y.id = p.b left join is_ on is_.a = p.a and is_.b = p.b left join id_ on id_.a = p.a and id_.b = p.b left join iw on iw.a = p.a and iw.b = p.b
   left join ns sa on sa.id = p.a left join ns sb on sb.id = p.b left join nd da on da.id = p.a left join nd db on db.id = p.b left join nw wa on wa.id = p.a left join nw wb on wb.id = p.b),
 knn as (select *, row_number() over (partition by source order by w desc, target) as rank from w where w > 0 qualify rank <= 10)"""


def oracle_sql() -> dict[str, str]:
    from medialoom.plans.readers import SQL

    search = "projects sets previews best list_items hits"
    index = """select s.id as set_id, p.name as project_name, concat('set ', cast(s.id as varchar)) as set_name,
      (select string_agg(name, ' ') from tracks t where t.set_id = s.id) as track_names, (select string_agg(name, ' ') from devices v where v.set_id = s.id) as device_names,
      (select string_agg(list_extract(string_split(path, '/'), -1), ' ') from samples m where m.set_id = s.id) as sample_names from sets s join projects p on p.id = s.project_id"""
    fields = {"project_name": 8.0, "set_name": 10.0, "track_names": 4.0, "device_names": 1.0, "sample_names": 0.5}
    part = "select p_partkey as id, concat(p_name, ' ', cast(p_partkey as varchar)) as name from part"
    folder = "concat('/s/', cast(l_suppkey as varchar))"
    return SQL | {
        "search_filtered": with_views(search + " devices", "select set_id, project, artist, als_path, tempo, has_preview, preview_source from hits where tempo >= 100 and tempo <= 160 and has_preview and preview_source <> 'sketch' and exists (select 1 from devices d where d.set_id = hits.set_id and lower(d.name) like '%promo%')"),
        "search_by_list_and_artist": with_views(search, "select set_id, project, artist, als_path, tempo, in_list from hits where lower(artist) like '%nation\\_1%' escape '\\' and exists (select 1 from list_items l where l.als_path = hits.als_path and l.list_id = 3)"),
        "search_recent_without_preview": with_views(search, "select set_id, project, artist, als_path, tempo, has_preview, in_list from hits where (not has_preview or preview_source = 'sketch') and mtime >= (select max(o_orderdate) from orders) - interval 30 day"),
        "search_bm25": "with " + bm25("doc_id", {"text": 1.0}, "select doc_id, text from documents", ["thor", "re"]),
        "search_bm25_multifield": with_views("projects sets tracks devices samples", ", " + bm25("set_id", fields, index, ["promo", "12"])).replace(") , d as", "), d as"),
        "artist_facet": with_views("projects sets", "select coalesce(s.artist_override, p.artist) as artist, count(*) as n from sets s join projects p on p.id = s.project_id group by coalesce(s.artist_override, p.artist)"),
        "catalog_stats": with_views("projects sets tracks devices samples previews export_jobs list_items", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("projects", "sets", "tracks", "devices", "samples", "previews", "export_jobs", "list_items"))),
        "set_detail_nested": with_views("sets tracks devices samples", """select id as set_id, als_path, tempo,
          (select string_agg(concat(cast(idx as varchar), ':', kind, ':', name), ',' order by idx, kind, name) from tracks t where t.set_id = sets.id) as tracks,
          (select string_agg(concat(kind, ':', manufacturer, ':', name), ',' order by kind, manufacturer, name) from devices d where d.set_id = sets.id) as devices,
          (select count(*) from samples m where m.set_id = sets.id) as n_samples from sets"""),
        "kind_histogram": with_views("tracks", "select set_id, count(*) filter (kind = 'audio') as n_audio, count(*) filter (kind = 'midi') as n_midi, count(*) filter (kind = 'group') as n_group, count(*) filter (kind = 'return') as n_return from tracks group by set_id"),
        "list_counts": with_views("lists list_items", "select id, name, (select count(*) from list_items i where i.list_id = lists.id) as n_items from lists"),
        "list_membership": with_views("sets lists list_items", "select s.als_path, count(l.id) > 0 as in_list, coalesce(string_agg(distinct l.name, ',' order by l.name), '') as lists from sets s left join list_items i on i.als_path = s.als_path left join lists l on l.id = i.list_id group by s.als_path"),
        "primary_preview": with_views("best", "select set_id, id, audio_path, source, confidence from best"),
        "suggestion_groups": with_views("previews", "select set_id, max(confidence) as best, string_agg(audio_path, ',' order by confidence desc, id) as paths from previews group by set_id"),
        "best_match_names": f"with p as ({part}), r as (select id, {normalized(chr(39).join(['concat(name, ', 'bpm FINAL v2 [2024-01-01]', ')']))} as rn from p), c as (select id, {normalized('name')} as cn from p), m as (select r.id as render_id, c.id as set_id, {similarity('rn', 'cn')} as score from r, c) select render_id, set_id, round(score, 6) as score from m where score >= 0.6 qualify row_number() over (partition by render_id order by score desc, set_id) = 1",
        "known_sample_guard": with_views("samples", "select p_partkey as id, concat('/samples/', upper(p_brand), '/', p_name, ' ', cast(p_partkey as varchar), case when p_partkey % 3 = 0 then ' alt' else '' end, '.WAV') as path from part where lower(concat('/samples/', upper(p_brand), '/', p_name, ' ', cast(p_partkey as varchar), case when p_partkey % 3 = 0 then ' alt' else '' end, '.WAV')) not in (select lower(path) from samples)"),
        "unpreviewed_projects": with_views("sets previews", "select distinct project_id from sets s where not exists (select 1 from previews v where v.set_id = s.id and v.source <> 'sketch')"),
        "wholly_unpreviewed_projects": with_views("projects sets previews", "select id, name from projects p where not exists (select 1 from sets s join previews v on v.set_id = s.id where s.project_id = p.id and v.source <> 'sketch')"),
        "previewed_projects_union": with_views("projects sets previews", "select id, id in (select s.project_id from previews v join sets s on s.id = v.set_id union select project_id from previews where project_id is not null) as has_preview from projects"),
        "sample_states": with_views("samples files states", "select state, count(distinct path) as n from states group by state"),
        "renderability": with_views("sets devices samples files states", """, inv as (select distinct unnest([lower(p_type), regexp_replace(lower(p_brand), 'brand#([0-9]+)', 'brand \\1') || ' kit']) as norm from part where p_type not in ('PROMO', 'SMALL')),
          gone as (select distinct name from devices d where kind <> 'native' and not exists (select 1 from inv where norm = lower(name) or contains(norm, lower(name)) or contains(lower(name), norm))),
          pl as (select set_id, count(*) as n, count(distinct g.name) as m, string_agg(distinct g.name, ',' order by g.name) as names from devices d left join gone g on g.name = d.name where kind <> 'native' group by set_id),
          sm as (select set_id, count(*) as n, count(*) filter (state = 'missing') as m, count(*) filter (state = 'evicted') as e from states group by set_id)
          select s.id as set_id, round(greatest(0, 1.0::double - least(0.12::double * coalesce(pl.m, 0), 0.6) - least(0.04::double * coalesce(sm.m, 0), 0.3) - least(0.01::double * coalesce(sm.e, 0), 0.1)), 6) as score, coalesce(pl.n, 0) as plugins_total, coalesce(pl.names, '') as missing_plugins,
          coalesce(sm.n, 0) as samples_total, coalesce(sm.m, 0) as samples_missing, coalesce(sm.e, 0) as samples_evicted from sets s left join pl on pl.set_id = s.id left join sm on sm.set_id = s.id""").replace(") , inv", "), inv"),
        "job_queue_next": with_views("export_jobs", "select id, set_id, score from export_jobs where status = 'pending' order by score is null, score desc, id limit 50"),
        "job_queue_display": with_views("export_jobs", "select id, status, case status when 'failed' then 0 when 'completed' then 1 when 'pending' then 2 else 3 end as rank, case when status = 'pending' then score end as score from export_jobs"),
        "job_queue_counts": with_views("export_jobs", "select count(*) filter (status = 'pending' and score is null) as n, count(*) filter (status = 'failed') as n_failed from export_jobs"),
        "job_queue_requeue": with_views("sets export_jobs", ", w as (select id from sets where id % 3 = 0), f as (select coalesce(j.set_id, w.id) as set_id, j.status, j.score, w.id is not null and coalesce(j.status, '') <> 'processing' as changed from export_jobs j full join w on w.id = j.set_id) select set_id, case when changed then 'pending' else status end as status, case when changed then null else score end as score, changed from f").replace(") , w", "), w"),
        "job_state_fold": "select user_id, arg_max(case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'click' then 'processing' else 'pending' end, {'t': ts, 'e': event_id}) as state, arg_max(event_id, {'t': ts, 'e': event_id}) as last_event, count(*) as n_events from events group by user_id",
        "freshness_diff": with_views("sets stored", "select s.als_path, s.id as file_size, s.mtime from sets s where not exists (select 1 from stored t where t.als_path = s.als_path and t.file_size = s.id and t.mtime = s.mtime)"),
        "prune_missing": with_views("sets stored", "select * from stored t where not (starts_with(als_path, '/lib/1-URGENT/') and not exists (select 1 from sets s where s.id % 4 <> 0 and s.als_path = t.als_path))"),
        "upsert_coalesce": with_views("projects", "select coalesce(b.folder_path, a.folder_path) as folder_path, coalesce(upper(b.name), a.name) as name, coalesce(case when b.id % 4 = 0 then 'New Artist' end, a.artist) as artist from (select * from projects where id % 3 <> 0) a full join (select * from projects where id % 2 = 0) b on a.folder_path = b.folder_path"),
        "replace_sets": with_views("sets", "select als_path, id, case when id % 2 = 0 then 120.0 else tempo end as tempo from sets where id % 3 <> 0 or id % 2 = 0"),
        "insert_if_absent": with_views("sets", "select distinct id % 5 as list_id, als_path from sets where id % 7 = 0 or id % 14 = 0 or id % 9 = 0"),
        "artist_tagging": with_views("sets", "select id, als_path, case when id % 6 = 0 then case when id % 4 = 0 then 'Tagged' end else artist_override end as artist_override from sets"),
        "relink_votes": f"with f as (select distinct {folder} as folder, l_partkey, l_suppkey from lineitem), n as (select folder, count(*) as n from f where l_suppkey % 2 = 0 group by folder), v as (select a.folder, b.folder as target, count(*) as votes from f a join f b using (l_partkey) where a.l_suppkey % 2 = 0 and b.l_suppkey % 2 = 1 group by all) select v.folder, target, votes, votes = n as complete from v join n using (folder) qualify row_number() over (partition by v.folder order by votes desc, target) = 1",
        "sample_lookup_tiers": f"""with h as (select concat('/f/', p_name, ' ', cast(p_partkey as varchar), case when p_partkey % 4 = 0 then '.wav' else '.aif' end) as path, cast(p_size as bigint) as mtime, {normalized("concat(p_name, ' ', cast(p_partkey as varchar))")} as hn, case when p_partkey % 4 = 0 then 'wav' else 'aif' end as ext from part where p_partkey % 2 = 0),
          w as (select p_partkey as id, {normalized("concat(p_name, '_', case when p_partkey % 3 = 0 then concat('x', cast(p_partkey * 2 as varchar)) else cast(p_partkey as varchar) end)")} as wn from part),
          e as (select id, path, mtime, case when ext = 'wav' then 0 else 1 end as tier from w join h on wn = hn),
          z as (select id, wn, replace(wn, ' ', '') as ws from w where wn <> '' and id not in (select id from e)),
          c as (select id, path, mtime, 2 as tier from z, h where replace(hn, ' ', '') = ws or (length(ws) >= 6 and (contains(replace(hn, ' ', ''), ws) or contains(ws, replace(hn, ' ', '')))) or {similarity('wn', 'hn')} >= 0.75)
          select id, path, tier, row_number() over (partition by id order by tier, mtime desc, path) as rank from (select * from e union all select * from c)""",
        "artist_from_path": "select p_partkey as id, case when p_partkey % 4 = 0 then p_brand when p_partkey % 4 = 2 then p_type end as artist from part",
        "tempo_band": with_views("sets", ", o as (select id, row_number() over (order by tempo asc nulls last, id) as pos from sets) select x.id, y.id as other from o x join o y on y.pos > x.pos and y.pos <= x.pos + 12").replace(") , o", "), o"),
        "tempo_kernel_pairs": with_views("sets", f"select x.id as a, y.id as b, round({kernel('x.tempo', 'y.tempo')}, 6) as fit from sets x join sets y using (project_id) where x.id <> y.id"),
        "sample_jaccard_knn": with_views("sets samples", ", r as (select distinct project_id, path from samples m join sets s on s.id = m.set_id), n as (select project_id, count(*) as n from r group by 1), g as (select path from r group by 1 having count(*) <= 400), i as (select x.project_id as a, y.project_id as b, count(*) as c from r x join g using (path) join r y using (path) where x.project_id <> y.project_id group by all), w as (select a, b, round(c / cast(na.n + nb.n - c as double), 6) as w from i join n na on na.project_id = a join n nb on nb.project_id = b) select a, b, w, row_number() over (partition by a order by w desc, b) as rank from w qualify rank <= 10").replace(") , r", "), r"),
        "name_tfidf_cosine": with_views("projects sets tracks samples devices", "," + _FEATURES + ", p as materialized (select x.id as a, y.id as b from s0 x join s0 y using (project_id) where x.id < y.id), dot as materialized (select a, b, sum(u.idf * v.idf) as dot from p join fw u on u.id = a join fw v on v.id = b and v.k = u.k group by all) select p.a, p.b, round(coalesce(dot / (na.norm * nb.norm), 0), 6) as cosine from p left join dot on dot.a = p.a and dot.b = p.b left join nw na on na.id = p.a left join nw nb on nb.id = p.b").replace(") ,\n", "),\n"),
        "similarity_edges": with_views("projects sets tracks samples devices", "," + _GRAPH + " select source, target, w, rank from knn"),
        "similarity_undirected_edges": with_views("projects sets tracks samples devices", "," + _GRAPH + " select distinct least(source, target) as source, greatest(source, target) as target from knn"),
        "overlap_truncate": "select event_id, user_id, round(least(epoch_us(ts) / 1e6 + value, coalesce(lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id), epoch_us(ts) / 1e6 + value)), 3) as eff_end from events",
        "loop_tiling": """with n as (select l_orderkey, l_linenumber, l_linenumber * 4.0 as a, l_linenumber * 4.0 + l_quantity as z, cast(l_partkey % 8 as double) as len, l_partkey % 3 <> 0 and l_partkey % 8 > 0 as loops, (l_partkey % 16) / 2.0 - 1 as rel from lineitem),
          t as (select *, unnest(case when not loops then [0] when rel >= 0 and rel < len then range(0, cast(ceil((z - a) / len) as bigint)) else [] end) as k from n)
          select l_orderkey, l_linenumber, cast(a + case when loops then k * len else 0 end + rel as double) as beat from t where a + case when loops then k * len else 0 end + rel >= a and a + case when loops then k * len else 0 end + rel < z""",
        "key_range_join": "select o_orderkey, p_partkey from orders join part on o_custkey % 50 = p_partkey % 50 where o_orderkey % 128 between p_size * 2 and p_size * 2 + p_partkey % 7",
        "audible_tracks": with_views("tracks", ", t as (select set_id, idx, kind = 'group' as mute, set_id % 4 = 0 and idx % 3 = 0 as solo from tracks), u as (select *, bool_or(solo) over (partition by set_id) as any_solo from t) select set_id, idx from u where case when any_solo then solo else not mute end").replace(") , t", "), t"),
        "peaks_downsample": "with f as (select user_id % 4 as key, event_id // 8 as c, least(max(abs(value / 500 - 1)), 1.0) as p from events group by all), n as (select *, max(c) over (partition by key) + 1 as n from f), b as (select key, p, case when n <= 100 then c else (select max(i) from range(100) r(i) where i * n // 100 <= c) end as bin from n) select key, bin, round(max(p), 6) as peak from b group by all",
        "mix_signals": "with s as (select user_id % 4 as key, event_id % 500 as frame, sum(value - 50) as v from events group by all) select key, frame, round(v * pow(10, -1.5 / 20) / max(abs(v)) over (partition by key), 6) as value from s",
        "time_signatures": "select p_partkey, concat(cast(p_partkey % 495 % 99 + 1 as varchar), '/', cast(cast(pow(2, p_partkey % 495 // 99) as bigint) as varchar)) as signature from part",
    }
