"""A session with the settings this library counts on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "medialoom", master: str | None = None, **settings: str) -> SparkSession:
    """A session; settings given here win, those of spark-submit win over SETTINGS."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own: dict[str, str] = {}

#: Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors see; a temporary one only where that is unset and all run
    on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="medialoom-")
        _own[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and read back from a table in the shared folder, so that what reads them twice does not compute
    them twice and a lost executor costs no lineage."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/medialoom/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
