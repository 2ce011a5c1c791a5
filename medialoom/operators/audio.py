"""Signals of one set, in numpy: decoding WAV, resampling, voices, the mix. One set is one row of work for a task."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from medialoom.operators.timeline import BINS, COARSE

PEAK = 10 ** (-1.5 / 20)
QUIET, TAIL = 1e-4, 0.5


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels in -1 to 1, sample rate) of PCM WAV bytes."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels), rate


def encode_wav(stereo: np.ndarray, rate: int) -> bytes:
    """16-bit stereo WAV of frames x 2, clamped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(stereo, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def waveform(x: np.ndarray) -> np.ndarray:
    """At most BINS peaks of frames x channels."""
    top = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
    coarse = np.minimum(np.maximum.reduceat(top, np.arange(0, len(top), COARSE)), 1.0) if len(top) else top
    if len(coarse) <= BINS:
        return coarse
    return np.maximum.reduceat(coarse, np.arange(BINS) * len(coarse) // BINS)


def stretched(x: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation of frames x channels to n frames, ends on ends."""
    if len(x) < 2 or n < 2:
        return np.repeat(x[:1], n, axis=0)
    at = np.linspace(0, len(x) - 1, n)
    return np.stack([np.interp(at, np.arange(len(x)), c) for c in x.T], axis=1)


def stereo(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    if rate != target and len(x) > 1:
        x = stretched(x, max(1, math.floor(len(x) * target / rate + 0.5)))
    return np.repeat(x, 2, axis=1) if x.shape[1] == 1 else x[:, :2]


def repitched(x: np.ndarray, semitones: int) -> np.ndarray:
    """Played faster or slower: twelve semitones up take half the time."""
    return x if not semitones or not len(x) else stretched(x, max(1, math.floor(len(x) / 2 ** (semitones / 12) + 0.5)))


def declicked(x: np.ndarray, rate: int) -> np.ndarray:
    """Raised-cosine ends of 1.5 and 5 ms."""
    if len(x) < 8:
        return x
    x = x.copy()
    ramp = lambda n: 0.5 * (1 - np.cos(np.pi * np.arange(n) / (n - 1)))[:, None]
    head, tail = min(int(rate * 0.0015), len(x) // 2), min(int(rate * 0.005), len(x) // 2)
    if head > 1:
        x[:head] *= ramp(head)
    if tail > 1:
        x[-tail:] *= ramp(tail)[::-1]
    return x


def faded(x: np.ndarray, head: int, tail: int) -> np.ndarray:
    """Linear fades of so many frames."""
    x = x.copy()
    if (n := min(head, len(x))) > 1:
        x[:n] *= np.linspace(0, 1, n)[:, None]
    if (n := min(tail, len(x))) > 1:
        x[-n:] *= np.linspace(1, 0, n)[:, None]
    return x


def voice(kind: str, frequency: float, seconds: float, velocity: int, rate: int) -> np.ndarray:
    """A note of a track without samples: noise that dies away, a falling sine, or three harmonics."""
    t = np.arange(int(max(seconds, 0.04) * rate)) / rate
    if kind == "perc":
        y = np.random.default_rng(len(t)).uniform(-1, 1, len(t)) * np.exp(-35 * t)
    elif kind == "kick":
        y = np.sin(2 * np.pi * np.cumsum(110 * np.exp(-30 * t) + 45) / rate) * np.exp(-9 * t)
    else:
        y = sum(a * np.sin(2 * np.pi * k * frequency * t) for k, a in ((1, 1.0), (2, 0.35), (3, 0.18))) / 1.53 * np.minimum(t / 0.006, 1) * np.exp(-1.6 * t)
    return declicked(np.repeat((y * velocity / 127 * 0.32)[:, None], 2, axis=1), rate)


def content_offset(clip: dict, bpm: float) -> float:
    """Seconds into its sample at which a clip begins, by its first two warp markers (pairs of second and beat)."""
    warp = clip["warp"]
    if clip["is_warped"] and len(warp) > 1 and warp[1][1] != warp[0][1]:
        (s0, b0), (s1, b1) = warp[0], warp[1]
        return max(0.0, s0 + (clip["loop_start"] - b0) * (s1 - s0) / (b1 - b0))
    return max(0.0, clip["loop_start"] * 60 / bpm)


def ends(clips: list[dict]) -> list[float]:
    """Where each clip ends once the next one of its track has cut it off."""
    out = [c["end"] for c in clips]
    order = sorted(range(len(clips)), key=lambda i: (clips[i]["track"], clips[i]["start"], i))
    for i, j in zip(order, order[1:], strict=False):
        if clips[i]["track"] == clips[j]["track"]:
            out[i] = min(out[i], clips[j]["start"])
    return out


def turns(clip: dict) -> Iterator[tuple[float, float, int, int]]:
    """(beat, length, pitch, velocity) of a clip's notes, those of a loop once for each turn."""
    length = clip["loop_end"] - clip["loop_start"]
    loops = clip["loop_on"] and length > 0
    for time, duration, pitch, velocity in clip["notes"]:
        at = time - clip["loop_start"]
        if loops and not 0 <= at < length:
            continue
        many = math.ceil((clip["end"] - clip["start"]) / length) if loops else 1
        for k in range(many):
            beat = clip["start"] + k * length * loops + at
            if clip["start"] <= beat < clip["end"]:
                yield beat, duration, pitch, velocity


def render(data: dict, resolve: Callable[[str | None, str | None], bytes | None], seconds: float = 60.0, rate: int = 44100) -> np.ndarray | None:
    """The mix of a parsed arrangement as frames x 2; None if nothing sounds. resolve gives the WAV bytes of a sample's paths."""
    from medialoom.sources.sets import voice_of

    tracks, bpm = data["tracks"], data["tempo"] if data["tempo"] > 0 else 120.0
    beat = 60 / bpm
    solo = any(t["solo"] for t in tracks)
    heard = {i for i, t in enumerate(tracks) if (t["solo"] if solo else not t["mute"])}
    audio, midi = ([c for c in data[k] if not c["disabled"] and c["track"] in heard] for k in ("clips", "midi_clips"))
    if not audio and not midi:
        return None
    length = max(c["end"] for c in audio + midi) * beat + 1
    frames = int((min(length, seconds) if seconds > 0 else length) * rate) + rate
    mix = np.zeros((frames, 2))
    decoded: dict[tuple, np.ndarray | None] = {}

    def sample(*paths) -> np.ndarray | None:
        if paths not in decoded:
            data_ = resolve(*paths)
            decoded[paths] = None if data_ is None else stereo(*decode_wav(data_), rate)
        return decoded[paths]

    def place(start: float, x: np.ndarray, gain: float) -> None:
        at = int(start * rate)
        if at < frames and not (seconds > 0 and start >= seconds):
            n = min(len(x), frames - at)
            mix[at : at + n] += x[:n] * gain

    for c, end in zip(audio, ends(audio), strict=True):
        wanted = int(max(0.0, (end - c["start"]) * beat) * rate)
        x = sample(c["path"], c["rel_path"]) if wanted else None
        if x is not None and len(part := x[int(content_offset(c, bpm) * rate) :][:wanted]):
            part = faded(part * c["sample_volume"] * tracks[c["track"]]["vol"], int(c["fade_in"] * beat * rate), int(c["fade_out"] * beat * rate))
            place(c["start"] * beat, declicked(part, rate), 1.0)
    for c, end in zip(midi, ends(midi), strict=True):
        track = tracks[c["track"]]
        for at, duration, pitch, velocity in turns(c):
            if at >= end:
                continue
            fits = [(p, x) for p in track["parts"] if p["key_min"] <= pitch <= p["key_max"] and (x := sample(p["path"], p["rel"])) is not None]
            for p, x in fits:
                cut = x[p["sstart"] : p["send"]] if p["send"] and p["send"] > p["sstart"] else x[p["sstart"] :]
                place(at * beat, declicked(repitched(cut, pitch - p["root"]), rate), velocity / 127 * 0.6 * track["vol"])
            if not fits:
                place(at * beat, voice(voice_of(track["name"]), 440 * 2 ** ((pitch - 69) / 12), duration * beat, velocity, rate), 1.0)
    top = np.abs(mix).max()
    if top > 0:
        mix *= PEAK / top
    loud = np.flatnonzero(np.abs(mix).max(axis=1) > QUIET)
    return mix[: min(frames, (loud[-1] if len(loud) else 0) + 1 + int(rate * TAIL))]


def peaks_of_files(files: DataFrame) -> DataFrame:
    """A row per WAV of a binaryFile table: path, seconds, peaks (three decimals); files that cannot be decoded have null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    x, rate = decode_wav(data)
                    rows.append((path, len(x) / rate, np.round(waveform(x), 3).tolist()))
                except (wave.Error, EOFError, KeyError):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "seconds", "peaks"])

    return files.select("path", "content").mapInPandas(run, "path string, seconds double, peaks array<double>")
