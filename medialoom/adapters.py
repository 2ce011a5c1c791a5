"""The catalog's tables: read from a warehouse folder, or adapted from the star schema of the test data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Projects, sets, tracks, devices, samples, previews and export jobs over star-schema tables in one folder.

    Columns are computed where they are read, so a query prunes the scan to what it uses.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        rows = self.table("customer").join(F.broadcast(self.table("nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
        return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("/lib/"), "c_mktsegment", F.lit("/"), "c_name").alias("folder_path"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("n_name")).alias("artist"), F.expr("timestamp '2024-01-29 00:00:00' - make_dt_interval(cast(c_custkey % 28 as int))").alias("last_scanned"))

    @cached_property
    def sets(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("project_id"),
            F.concat(F.lit("/lib/"), "o_orderpriority", F.lit("/set "), key.cast("string"), F.lit(".als")).alias("als_path"),
            F.when(key % 17 != 0, (60 + (key * 37) % 140).cast("double")).alias("tempo"),
            F.col("o_orderdate").alias("mtime"),
            F.when(key % 11 == 0, F.col("o_orderpriority")).alias("artist_override"),
        )

    @cached_property
    def _items(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def tracks(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "N", "midi").otherwise("group")
        return self._items.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("idx"), kind.alias("kind"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))

    @cached_property
    def devices(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "native").otherwise("vst3")
        return self._items.select(F.col("l_orderkey").alias("set_id"), F.col("p_type").alias("name"), F.col("p_brand").alias("manufacturer"), kind.alias("kind"))

    @cached_property
    def samples(self) -> DataFrame:
        path = F.concat(F.lit("/Samples/"), "p_brand", F.lit("/"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".wav"))
        return self._items.select(F.col("l_orderkey").alias("set_id"), path.alias("path"))

    @cached_property
    def previews(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.floor(F.col("event_id") / 3).alias("set_id"),
            F.when(F.col("event_id") % 40 == 0, F.col("event_id") % 100).alias("project_id"),
            F.concat(F.lit("/r/"), F.col("event_id").cast("string"), F.lit(".wav")).alias("audio_path"),
            F.when(F.col("event_type") == "error", "sketch").otherwise("discovered").alias("source"),
            (F.col("value") / 1000).alias("confidence"),
            F.col("ts").alias("mtime"),
        )

    @cached_property
    def export_jobs(self) -> DataFrame:
        by = F.col("event_id") % 4
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("set_id"),
            F.when(by == 0, "pending").when(by == 1, "processing").when(by == 2, "completed").otherwise("failed").alias("status"),
            F.when(F.col("event_id") % 3 != 0, F.col("value") / 1000).alias("score"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        """The log of export jobs: what happened to each, in order of (ts, event_id)."""
        state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("pending")
        return self.table("events").select(F.col("user_id").alias("job"), "ts", "event_id", state.alias("state"))

    @cached_property
    def lists(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def list_items(self) -> DataFrame:
        """Every seventh set is in the list of its number."""
        return self.sets.where(F.col("id") % 7 == 0).select((F.col("id") % 5).alias("list_id"), "als_path")
