"""The export queue as a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: action -> (states it applies to, state it leads to)
TRANSITIONS = {"queue": ({"none", "pending", "completed", "failed"}, "pending"), "start": ({"pending"}, "processing"), "finish": ({"processing"}, "completed"), "fail": ({"processing"}, "failed"), "retry": ({"failed"}, "pending"), "reset": ({"processing"}, "pending"), "remove": ({"none", "pending", "completed", "failed", "processing"}, "none")}


def follow(state: str, actions: list[str]) -> str:
    """The state of a job after actions in order; one that does not apply to the state is passed over."""
    for a in actions:
        of, to = TRANSITIONS.get(a, (set(), state))
        state = to if state in of else state
    return state


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def job_states(events: DataFrame) -> DataFrame:
    """events(set_id, ts, action) of a stream, folded to the state of each set's job: a row whenever it has new events."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("none", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "action"])
        now, n = follow(now, rows["action"].tolist()), n + len(rows)
        state.update((now, n))
        yield pd.DataFrame({"set_id": [key[0]], "state": [now], "n_events": [n]})

    return events.groupBy("set_id").applyInPandasWithState(fold, "set_id bigint, state string, n_events bigint", "state string, n bigint", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each type in each window of time; what is later than `late` is left out and its state let go."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")
