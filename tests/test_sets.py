import gzip
import json
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialoom.operators import audio, timeline
from medialoom.sources import sets

HEAD = '<Ableton Creator="Live 11.3.43" MinorVersion="11.0_11300"><LiveSet>'
BODY = """<Tracks>
 <MidiTrack Id="1"><Name><EffectiveName Value="808 Bass"/></Name><Color Value="7"/><DeviceChain><Devices><Operator Id="0"/>
  <PluginDevice Id="1"><PluginDesc><VstPluginInfo><PlugName Value="Serum"/><Manufacturer Value="Xfer"/></VstPluginInfo></PluginDesc></PluginDevice></Devices></DeviceChain>
  <Notes><MidiTrack Id="9"><Name><EffectiveName Value="no"/></Name></MidiTrack></Notes></MidiTrack>
 <AudioTrack Id="2"><Name><EffectiveName Value="Vox"/></Name><SampleRef><FileRef><Path Value="/lib/song Project/Samples/kick.wav"/></FileRef></SampleRef>
  <SampleRef><FileRef><Path Value="/lib/song Project/Samples/kick.wav"/></FileRef></SampleRef></AudioTrack></Tracks>
 <MasterTrack><Mixer><Tempo><Manual Value="140.004"/></Tempo><TimeSignature><Manual Value="201"/></TimeSignature></Mixer></MasterTrack>
 <Locators><Locators><Locator Id="0"><Name Value="Drop"/><Time Value="64"/></Locator></Locators></Locators>"""
TAIL = "</LiveSet></Ableton>"


def packed(body):
    return gzip.compress((HEAD + body + TAIL).encode())


def test_snapshot():
    r = sets.parse_set(packed(BODY), "song Project")
    assert (r["tempo"], r["tempos"], r["time_signature"], r["warnings"]) == (140.004, [140.0], "4/4", [])
    assert r["tracks"] == [{"kind": "midi", "name": "808 Bass", "color": 7}, {"kind": "audio", "name": "Vox", "color": None}]
    assert [(d["track"], d["kind"], d["name"], d["manufacturer"]) for d in r["devices"]] == [("0", "native", "Operator", "Ableton"), ("0", "vst", "Serum", "Xfer")]
    assert r["samples"] == [{"path": "/lib/song Project/Samples/kick.wav", "in_project": True}] and r["locators"] == [{"name": "Drop", "time": 64.0}]
    assert sets.parse_set(packed(BODY.replace("MasterTrack", "MainTrack")), "x")["tempo"] == 140.004


def test_warnings():
    loose = sets.parse_set(packed(BODY.replace("MasterTrack", "OtherTrack")), "song Project")
    assert loose["tempo"] == 140.004 and "tempo not found in master-track context; using first occurrence" in loose["warnings"]
    none = sets.parse_set(packed("<Tracks/>"), "x")
    assert none["tempo"] is None and none["warnings"] == ["tempo not found", "time_signature not found"]


def tree(root):
    for name in ("song Project/a.als", "song Project/b.als", "song Project/Backup/a [2024].als", "other/c.als"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(packed(BODY))
    (root / "other/broken.als").write_bytes(packed(BODY)[:200])


def test_tree(spark, tmp_path):
    tree(tmp_path)
    found = sets.projects(spark, str(tmp_path)).collect()
    assert [(r.name, len(r.als_files), [b.file for b in r.backups]) for r in found] == [("other", 2, []), ("song Project", 2, ["a [2024].als"])]
    rows = {r.als_path.split("/")[-1]: r for r in sets.snapshots(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.als", "b.als", "c.als", "broken.als"}
    assert rows["broken.als"].error and rows["a.als"].error is None and rows["a.als"].tracks[0].name == "808 Bass"
    assert not rows["c.als"].samples[0].in_project and rows["a.als"].samples[0].in_project
    only = spark.createDataFrame([(str(tmp_path / "other/c.als"),)], "als_path string")
    assert sets.snapshots(spark, str(tmp_path), only).count() == 1


def test_renders_and_roots(spark):
    rows = [("/r/a.wav", 2_000_000), ("/r/b.wav", 10), ("/r/Samples/c.wav", 2_000_000), ("/r/x/y/d.mp3", 200_000), ("/r/.h/e.wav", 2_000_000), ("/r/f.txt", 9_000_000)]
    files = spark.createDataFrame(rows, "path string, size bigint")
    assert {r.path for r in sets.renders(files, "/r").collect()} == {"/r/a.wav", "/r/x/y/d.mp3"}
    assert {r.path for r in sets.renders(files, "/r", 2).collect()} == {"/r/a.wav"}
    assert sets.search_roots(["/", "/home/u", "/home/u/m", "/home/u/m/x", "/vol/d/s", "/vol/d/s"], "/home/u") == ["/home/u/m", "/vol/d/s"]


def test_tasks_list_and_read_files(spark, tmp_path):
    """The driver gets no list of files: what is listed and read comes from tasks, over as many of them as a shuffle has."""
    for i in range(300):
        folder = tmp_path / f"seg {i % 3}" / f"p{i} Project"
        (folder / "Backup").mkdir(parents=True)
        (folder / "a.als").write_bytes(packed(BODY))
        (folder / "Backup" / "a [1].als").write_bytes(b"x")
    for name in (".hidden/b.als", "seg 0/_no.als", "seg 0/empty.als", "seg 0/x.txt", "top.als"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else packed(BODY))
    rows = sets.listing(spark, f"file://{tmp_path}", "*.als")
    found = {r.path: r for r in rows.collect()}
    assert len(found) == 601 and f"{tmp_path}/top.als" in found
    one = f"{tmp_path}/seg 1/p1 Project/a.als"
    assert found[one].size == len(packed(BODY)) and abs(found[one].mtime.timestamp() - (tmp_path / one).stat().st_mtime) < 1
    for df in (rows, sets.arrangements(spark, str(tmp_path)), sets.snapshots(spark, str(tmp_path))):
        assert not df.inputFiles() and df.rdd.getNumPartitions() == 4
    assert sets.set_files(spark, str(tmp_path)).where("length(content) = file_size").count() == 301


def test_sample_index_has_every_file(spark):
    files = spark.range(260_000).select(F.format_string("/s/%d.wav", "id").alias("path"))
    assert sets.sample_index(files).count() == 260_000


def test_relinked():
    body = BODY.replace('<Path Value="/lib/song Project/Samples/kick.wav"/>', '<RelativePathType Value="3"/><RelativePath Value="a/b"/><Path Value="/lib/song Project/Samples/kick.wav"/>', 1)
    out = sets.relinked(packed(body), {"/lib/song Project/Samples/kick.wav": "/new & old/k.wav"})
    text = gzip.decompress(out).decode()
    assert '<RelativePathType Value="0"/><RelativePath Value=""/>' in text
    assert [s["path"] for s in sets.parse_set(out, "x")["samples"]] == ["/new & old/k.wav"]


ARRANGEMENT = """<Tracks><MidiTrack Id="1"><Name><EffectiveName Value="Kick"/></Name><DeviceChain><Mixer><Speaker><Manual Value="true"/></Speaker><Volume><Manual Value="0.5"/></Volume><Solo Value="false"/></Mixer>
 <MidiClip Time="0"><CurrentStart Value="0"/><CurrentEnd Value="8"/><Loop><LoopStart Value="0"/><LoopEnd Value="4"/><LoopOn Value="true"/></Loop><Disabled Value="false"/>
  <Notes><KeyTracks><KeyTrack><Notes><MidiNoteEvent Time="1" Duration="0.5" Velocity="100"/><MidiNoteEvent Time="2" Duration="1" Velocity="9" IsEnabled="false"/></Notes><MidiKey Value="60"/></KeyTrack></KeyTracks></Notes></MidiClip>
 <ClipSlot><MidiClip><CurrentStart Value="0"/><CurrentEnd Value="8"/></MidiClip></ClipSlot></DeviceChain></MidiTrack>
 <AudioTrack Id="2"><DeviceChain><Mixer><Speaker><Manual Value="false"/></Speaker></Mixer><AudioClip><CurrentStart Value="0"/><CurrentEnd Value="4"/><SampleRef><FileRef><Path Value="/k.wav"/></FileRef></SampleRef></AudioClip></DeviceChain></AudioTrack></Tracks>
 <MasterTrack><Tempo><Manual Value="120"/></Tempo></MasterTrack>"""


def test_arrangement_and_mix():
    a = sets.parse_arrangement(packed(ARRANGEMENT))
    assert a["tempo"] == 120 and [t["mute"] for t in a["tracks"]] == [False, True] and a["tracks"][0]["vol"] == 0.5
    assert len(a["midi_clips"]) == 1 and a["midi_clips"][0]["notes"] == [(1.0, 0.5, 60, 100)] and a["clips"][0]["path"] == "/k.wav"
    assert [x[0] for x in audio.turns(a["midi_clips"][0])] == [1.0, 5.0]
    mix = audio.render(a, lambda *_: None, rate=8000)
    assert abs(np.abs(mix).max() - 10 ** (-1.5 / 20)) < 1e-9 and len(mix) < 5 * 8000
    for t in a["tracks"]:
        t["mute"] = True
    assert audio.render(a, lambda *_: None) is None


def test_signals():
    x = np.linspace(-1, 1, 1000)[:, None]
    assert len(audio.repitched(x, 12)) == 500 and len(audio.repitched(x, 0)) == 1000
    data = audio.encode_wav(np.repeat(x, 2, axis=1), 8000)
    back, rate = audio.decode_wav(data)
    assert rate == 8000 and np.abs(back[:, 0] - x[:, 0]).max() < 1e-3
    assert audio.declicked(np.ones((1000, 2)), 44100)[0, 0] == 0 and audio.declicked(np.ones((1000, 2)), 44100)[-1, 0] == 0
    assert audio.content_offset({"is_warped": True, "warp": [(0, 0), (1, 2)], "loop_start": 4.0}, 120) == 2.0
    assert audio.ends([{"track": 0, "start": 0, "end": 9}, {"track": 0, "start": 4, "end": 6}, {"track": 1, "start": 1, "end": 2}]) == [4, 6, 2]
    long = np.random.default_rng(0).uniform(-1, 1, (2048 * 4000, 1))
    assert len(audio.waveform(long)) == 1500 and len(audio.waveform(long[:5000])) == 3


def test_peaks_of_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((np.sin(np.arange(8000)) * 32767).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"not audio")
    rows = {r.path.split("/")[-1]: r for r in audio.peaks_of_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.wav"].seconds == 1.0 and len(rows["a.wav"].peaks) == 4 and rows["b.wav"].peaks is None


def test_tiling_against_plain(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 4) * 1.0, 0.0, rng.choice([0.0, 1.0]), rng.randint(0, 6) * 0.5, rng.random() < 0.6, rng.randint(0, 8) * 0.25) for i in range(80)]
    rows = [(i, s, s + rng.randint(1, 12) * 0.5, ls, ls + le, on, t) for i, s, _, ls, le, on, t in rows]
    df = spark.createDataFrame(rows, "id int, clip_start double, clip_end double, loop_start double, loop_end double, loop_on boolean, time double")
    got = sorted((r.id, r.beat) for r in timeline.tiled(df).collect())
    want = sorted((i, b) for i, s, e, ls, le, on, t in rows for b, *_ in audio.turns({"start": s, "end": e, "loop_start": ls, "loop_end": le, "loop_on": on, "notes": [(t, 1, 60, 1)]}))
    assert got == want


def test_zones_meet_only_parts_of_their_key(spark):
    notes = [(i, i % 3, p) for i, p in enumerate([0.0, 1.5, 2.0, 3.99, 4.0, 127.0, -1.0, None, 60.0])]
    parts = [(i, i % 3, low, low + w) for i, (low, w) in enumerate((low, w) for low in (-1.0, 0.0, 1.25, 3.99, 60.0, 126.5) for w in (-1.0, 0.0, 0.5, 4.0, 127.0))]
    df = timeline.zones(spark.createDataFrame(notes, "n int, t int, p double"), spark.createDataFrame(parts, "m int, t int, a double, b double"), "t", "p", "a", "b")
    want = sorted((n, m) for n, t, p in notes for m, u, a, b in parts if t == u and p is not None and a <= p <= b)
    assert sorted((r.n, r.m) for r in df.collect()) == want and sorted(df.columns) == ["a", "b", "m", "n", "p", "t"]
    # 200 notes and 200 parts of one track, each of a key of its own: 200 rows come out of the join, not 40,000 that are filtered
    a, b = spark.range(200).selectExpr("id as n", "1 as t", "id as p"), spark.range(200).selectExpr("id as m", "1 as t", "id as a", "id as b")
    plan = timeline.zones(a, b, "t", "p", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan.split("Join Inner", 1)[1].split("\n")[0]


def test_zones_are_dealt_by_key_and_take_little_disk(spark, tmp_path):
    notes = spark.range(4000).selectExpr("id as n", "1 as t", "id * 7919 % 16 as p")
    parts = spark.range(8000).selectExpr("id as m", "1 as t", "id % 16 as a", "id % 16 as b")
    df = timeline.zones(notes, parts, "t", "p", "a", "b").select("n", "m")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.write.parquet(str(tmp_path / "zones"))
    assert spark.read.parquet(str(tmp_path / "zones")).count() == 2_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "zones").glob("*.parquet")) < 1_000_000


def test_peaks_against_plain(spark):
    x = np.random.default_rng(1).uniform(-1, 1, 5000)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, f int, v double")
    got = {r.bin: r.peak for r in timeline.peaks(df, "k", "f", "v", coarse=8, bins=100).collect()}
    coarse = [np.abs(x[i : i + 8]).max() for i in range(0, 5000, 8)]
    n = len(coarse)
    want = [max(coarse[i * n // 100 : max((i + 1) * n // 100, i * n // 100 + 1)]) for i in range(100)]
    assert [got[i] for i in range(100)] == pytest.approx(want)


def test_json(spark):
    from medialoom.operators.ingest import library_json

    row = library_json(spark.createDataFrame([(1, ["a"])], "id int, w array<string>")).first()[0]
    assert json.loads(row) == {"id": 1, "w": ["a"]}
    assert math.isclose(spark.range(1).select(F.lit(1.0)).first()[0], 1.0)
