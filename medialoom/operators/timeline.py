"""Clips and notes as intervals on tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COARSE, BINS = 2048, 1500


def audible(tracks: DataFrame) -> DataFrame:
    """tracks(set_id, idx, mute, solo) that sound: the soloed ones where there are any, else those not muted."""
    any_solo = F.max(F.col("solo")).over(Window.partitionBy("set_id"))
    return tracks.withColumn("any_solo", any_solo).where(F.when(F.col("any_solo"), F.col("solo")).otherwise(~F.col("mute"))).drop("any_solo")


def truncated(clips: DataFrame, track: str, start: str, end: str, order: str) -> DataFrame:
    """clips with `eff_end`: the end, or where the next clip of the track starts if that comes first."""
    upcoming = F.lead(start).over(Window.partitionBy(track).orderBy(start, order))
    return clips.withColumn("eff_end", F.least(F.col(end), F.coalesce(upcoming, F.col(end))))


def tiled(notes: DataFrame) -> DataFrame:
    """Notes of looped clips, once for every turn of the loop that begins before the clip ends.

    notes: clip_start, clip_end, loop_start, loop_end, loop_on, time and what else belongs to a note; adds beat.
    """
    span, length, at = F.col("clip_end") - F.col("clip_start"), F.col("loop_end") - F.col("loop_start"), F.col("time") - F.col("loop_start")
    looped = F.col("loop_on") & (length > 0)
    turns = F.when(looped, F.when((at >= 0) & (at < length) & (span > 0), F.sequence(F.lit(0), F.greatest(F.ceil(span / length) - 1, F.lit(0)).cast("int")))).otherwise(F.array(F.lit(0)))
    rows = notes.withColumn("turn", F.explode(turns))
    beat = F.col("clip_start") + F.when(looped, F.col("turn") * length).otherwise(0.0) + at
    return rows.withColumn("beat", beat).where((F.col("beat") >= F.col("clip_start")) & (F.col("beat") < F.col("clip_end"))).drop("turn")


def zones(notes: DataFrame, parts: DataFrame, track: str, pitch: str, low: str, high: str) -> DataFrame:
    """Each note with the sample parts of its track in whose range of keys it lies.

    A part stands for every whole key that its range touches (there are 128), so that a note meets only the parts of its key.
    Both sides are dealt by track and key, and nothing is broadcast: the driver does not hold the parts of all keys, and the rows
    of a key come one after the other, so that tables of them are small on disk however many they are.
    """
    keys = F.when(F.col(low) <= F.col(high), F.sequence(F.floor(low), F.floor(high)))
    held = parts.withColumn("_key", F.explode(keys))
    rows = notes.withColumn("_key", F.floor(pitch)).join(held.hint("merge"), [track, "_key"])
    return rows.where(F.col(pitch).between(F.col(low), F.col(high))).drop("_key")


def peaks(frames: DataFrame, key: str, frame: str, value: str, coarse: int = COARSE, bins: int = BINS) -> DataFrame:
    """The waveform of each key in at most `bins` bins: the greatest magnitude in each `coarse` frames, then in each group."""
    rows = frames.groupBy(key, F.floor(F.col(frame) / coarse).alias("c")).agg(F.least(F.max(F.abs(F.col(value))), F.lit(1.0)).alias("p"))
    rows = rows.withColumn("n", F.max("c").over(Window.partitionBy(key)) + 1)
    # Bin i takes coarse bins floor(i n / bins) up to floor((i + 1) n / bins): the bin of c is the last whose first is c or less.
    last = F.floor(((F.col("c") + 1) * bins - 1) / F.col("n"))
    rows = rows.withColumn("bin", F.when(F.col("n") <= bins, F.col("c")).otherwise(last))
    return rows.groupBy(key, "bin").agg(F.max("p").alias("peak"))


def mixed(signals: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """The sum of all signals of a key, frame by frame, with the peak at -1.5 dB."""
    rows = signals.groupBy(key, frame).agg(F.sum(value).alias("v"))
    top = F.max(F.abs("v")).over(Window.partitionBy(key))
    return rows.select(key, frame, F.when(top > 0, F.col("v") * (10 ** (-1.5 / 20)) / top).otherwise(0.0).alias("value"))
