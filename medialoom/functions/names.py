"""Names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which song a render is.
RENDER_STOPWORDS = ["final", "finals", "master", "mastered", "mix", "mixdown", "bounce", "bounced", "export", "exported", "render", "demo", "rough", "draft", "edit", "full", "song", "track", "new", "old", "copy"]
# Words that the similarity graph leaves out.
GRAPH_STOPWORDS = ["the", "and", "for", "set", "als", "ableton", "project", "live", "copy", "final", "new", "untitled", "version", "wav", "mix", "master"]
# Month folders, and folders that organise but name no artist.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
BUCKETS = ["projects", "project", "ableton", "live", "music", "sets", "tracks", "ideas", "idea", "sketches", "beats", "loops", "stems", "samples", "bounces", "exports", "renders", "wip", "drafts", "draft", "misc", "unsorted", "new", "old", "random", "untitled"]
MARKERS = ["artists", "artist"]


def without_brackets(text: Column) -> Column:
    """text without what stands in [..] or {..}, however nested; an unclosed bracket runs to the end."""

    def step(state: Column, c: Column) -> Column:
        opens, closes = c.isin("[", "{"), c.isin("]", "}")
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        kept = F.when(opens | closes | (state["depth"] > 0), state["kept"]).otherwise(F.concat(state["kept"], c))
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))
    return F.when(text.rlike(r"[\[\]{}]"), F.aggregate(F.split(text, ""), start, step)["kept"]).otherwise(text)


def normalize(name: Column) -> Column:
    """A render's or set's name in comparable form: small letters, words and numbers apart, without noise words and versions."""
    words = F.split(F.trim(F.regexp_replace(without_brackets(F.lower(name)), r"[^\p{IsAlphabetic}\p{N}]+", " ")), " ")
    words = F.filter(words, lambda w: (w != "") & ~w.isin(RENDER_STOPWORDS) & ~w.rlike("^v[0-9]+$"))
    return F.regexp_replace(F.array_join(words, " "), r"(?<=[0-9])(?=\p{IsAlphabetic})|(?<=\p{IsAlphabetic})(?=[0-9])", " ")


def words_of(name: Column) -> Column:
    """The different words of a normalised name."""
    return F.filter(F.array_distinct(F.split(name, " ")), lambda w: w != "")


def similarity(a: Column, b: Column) -> Column:
    """Of two normalised names, 0 to 1: equal 1, one the beginning of the other 0.85, else the Jaccard similarity of their words."""
    both, either = F.size(F.array_intersect(words_of(a), words_of(b))), F.size(F.array_union(words_of(a), words_of(b)))
    begins = a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" ")))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(begins, 0.85).otherwise(F.when(either == 0, 0.0).otherwise(both / either))


def graph_words(text: Column) -> Column:
    """The different ASCII words of two letters or more that the similarity graph compares."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(GRAPH_STOPWORDS)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def device_key(manufacturer: Column, name: Column) -> Column:
    """manufacturer:name in small letters; null if both are missing."""
    return F.nullif(F.concat(F.lower(F.coalesce(manufacturer, F.lit(""))), F.lit(":"), F.lower(F.coalesce(name, F.lit("")))), F.lit(":"))


def project_title(name: Column) -> Column:
    return F.regexp_replace(name, "( Project)+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def not_an_artist(part: Column) -> Column:
    """Whether a folder is a year, a month or a bucket."""
    low = F.lower(part)
    return part.rlike("^(19|20)[0-9]{2}$") | low.isin(MONTHS) | low.rlike("^(0?[1-9]|1[0-2])$") | low.isin(BUCKETS)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def marked_artist(path: Column) -> Column:
    """The folder after an `artists` folder, unless it is the project itself or no artist's name."""
    parts = _segments(path)
    named = F.transform(parts, lambda s, i: F.when((i > 0) & (i < F.size(parts) - 1) & F.lower(F.get(parts, i - 1)).isin(MARKERS) & (F.trim(s) != "") & ~not_an_artist(F.trim(s)), F.trim(s)))
    return F.get(F.filter(named, lambda s: s.isNotNull()), F.lit(0))


def artist_of(root: Column, path: Column) -> Column:
    """marked_artist, or else the first folder between the scan root and the project that can be an artist's name."""
    base = F.regexp_replace(root, "/+$", "")
    below = F.when(path.startswith(F.concat(base, F.lit("/"))), _segments(F.substring(path, F.length(base) + 1, F.length(path))))
    folders = F.transform(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), lambda s: F.trim(s))
    free = F.filter(folders, lambda s: (s != "") & ~not_an_artist(s) & ~F.lower(s).isin(MARKERS))
    return F.coalesce(marked_artist(path), F.get(free, F.lit(0)))


# Words of percussion tracks.
PERCUSSION = ["snare", "clap", "hat", "hi-hat", "hihat", "rim", "perc", "crash", "cymbal", "shaker", "tom", "snap", "conga", "bongo"]


def synth_kind(track: Column) -> Column:
    """The voice of a track without samples, by its name: kick, perc or tonal."""
    low = F.lower(F.coalesce(track, F.lit("")))
    return F.when(low.contains("kick"), "kick").when(low.rlike("|".join(PERCUSSION)), "perc").otherwise("tonal")
