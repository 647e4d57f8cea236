"""File events: which count, the debounce on a stream, and event rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.debounce import debounce
from ..sources.files import wanted

c = F.col


def file_events(events: DataFrame) -> DataFrame:
    """T4: events of drawing files that were created or modified."""
    return events.filter(wanted(c("path")) & c("event").isin("created", "modified"))


class Debounce(StatefulProcessor):
    """The last accepted time of a path as state, and a timer by which it goes.

    When the watermark has passed the last accepted time and the gap, any event that can
    still come is accepted anyway, so the state goes then.  Of a batch, times alone are held
    (16 bytes an event; ``maxBytesPerTrigger`` bounds a batch); after an accepted event the
    next one is found by binary search.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, ids = [], []
        for batch in rows:
            times.append(batch["us"].to_numpy())
            ids.append(batch["event_id"].to_numpy())
        us, event = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((event, us))
        us, event = us[order], event[order]
        before = self.last.get()[0] if self.last.exists() else None
        at, taken = 0 if before is None else int(np.searchsorted(us, before + self.gap)), []
        while at < len(us):
            taken.append(at)
            at = int(np.searchsorted(us, us[at] + self.gap))
        if taken:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.last.update((int(us[taken[-1]]),))
            self.handle.registerTimer((int(us[taken[-1]]) + self.gap) // 1000 + 1)
        yield pd.DataFrame({"path": [key[0]] * len(taken), "event_id": event[taken], "us": us[taken]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"path": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "us": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, seconds: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """(path, event_id, ts) of accepted events of a stream (path, event_id, ts), by event time.

    Acceptance is at once, as its batch comes.  An event that comes later than ``late`` behind
    the newest is dropped; one that comes late but within it counts as too close if it lies
    before the last accepted one's time and the gap.  Of events at one time the least id
    stands for all.
    """
    rows = events.filter("ts IS NOT NULL").select(F.coalesce("path", F.lit("")).alias("path"), "event_id", F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
    made = rows.groupBy("path").transformWithStateInPandas(Debounce(int(seconds * 1_000_000)), "path string, event_id bigint, us bigint", "Append", "EventTime")
    return made.select("path", "event_id", F.timestamp_micros("us").alias("ts"))


#: The store that keeps state with timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_debounce(spark: SparkSession, folder: str, out: str, checkpoint: str, seconds: float = 2.0, late: str = "10 seconds", most_bytes: int = 1 << 30) -> None:
    """Take what has come into ``folder`` (Parquet: path, event_id, ts) since the last run through T2 into ``out``, and end.

    The state outlives the run in ``checkpoint``.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        events = spark.readStream.schema("path string, event_id bigint, ts timestamp").option("maxBytesPerTrigger", str(most_bytes)).parquet(folder)
        writer = debounced_stream(events, seconds, late).writeStream.format("parquet").outputMode("append")
        writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_rows(events: DataFrame, components: DataFrame, mismatches: DataFrame, impact: DataFrame) -> DataFrame:
    """By drawing of a batch, its event, components, mismatches and affected drawings; ``impact``: rows, or counts of them (n)."""
    n = lambda df, key, name: df.groupBy(c(key).alias("drawing_id")).agg((F.sum("n") if "n" in df.columns else F.count("*")).alias(name))
    found = mismatches.select(F.explode("drawings_involved").alias("drawing_id"))
    rows = events.join(n(components, "drawing_id", "n_components"), "drawing_id", "left").join(n(found, "drawing_id", "n_mismatches"), "drawing_id", "left").join(n(impact, "source_drawing_id", "n_affected"), "drawing_id", "left")
    return rows.fillna(0, ["n_components", "n_mismatches", "n_affected"])


__all__ = ["Debounce", "debounce", "debounced_stream", "event_rows", "file_events", "run_debounce"]
