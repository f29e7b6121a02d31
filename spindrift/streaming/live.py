"""Captures that grow: events from files as they land, busy intervals and begin/end pairs with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Stream of Parquet event files below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def busy_sessions(events: DataFrame, keys: list[str], ts: str = "ts", dur: str = "dur", late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): merged busy intervals, each event's own length being its session gap; final once the watermark passes."""
    timed = events.where(f"{dur} > 0").select(*keys, F.expr(f"timestamp_micros({ts})").alias("t"), F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast({dur} / 1000000 as decimal(18, 6)))").alias("d"))
    out = timed.withWatermark("t", late).groupBy(*keys, F.expr("session_window(t, d)").alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.expr("unix_micros(w.start)").alias("start"), F.expr("unix_micros(w.end)").alias("end"), "n")


def windowed_categories(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, device, category, n, total_us) in tumbling windows."""
    timed = events.withColumn("t", F.expr(f"timestamp_micros({ts})")).withWatermark("t", late)
    out = timed.groupBy(F.window("t", width).alias("w"), "device", "category").agg(F.count("*").alias("n"), F.sum("dur").alias("total_us"))
    return out.select(F.expr("unix_micros(w.start)").alias("ws"), "device", "category", "n", "total_us")


#: Where the state of ``pair_ends`` lives: on the executors' disks, with changes in the checkpoint, so it may outgrow memory.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class OpenBegins(StatefulProcessor):
    """The open begin of each key; a timer of event time forgets it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_ = self.begun.get()[0] if self.begun.exists() else None
        news, out = pd.concat(list(rows)).sort_values("seq"), []
        for ph, ts in zip(news["ph"], news["ts"], strict=True):
            if ph == "B":
                open_ = int(ts)
            elif ph == "E" and open_ is not None:
                out.append((key[0], open_, int(ts) - open_))
                open_ = None
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if open_ is None:
            self.begun.clear()
        else:
            self.begun.update((open_,))
            self.handle.registerTimer(max(open_ // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "ts", "dur"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begun.clear()
        yield pd.DataFrame([], columns=["key", "ts", "dur"])

    def close(self) -> None:
        pass


def pair_ends(marks: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(key, ts, dur): ends of open begins, by ``key`` with columns ``ph`` (B or E), ``ts`` and ``seq``; the latest begin counts.

    The state of a key is one open begin; one that the watermark has left behind by ``idle_ms`` is forgotten. A stream that is stopped
    goes on from its checkpoint with the begins that were open. Sets the session's state store to ``STORE``, which this state needs.
    """
    for k, v in STORE.items():
        marks.sparkSession.conf.set(k, v)
    timed = marks.withColumn("t", F.expr("timestamp_micros(ts)")).withWatermark("t", late)
    return timed.groupBy("key").transformWithStateInPandas(OpenBegins(idle_ms), "key string, ts long, dur long", "Append", "eventTime")
