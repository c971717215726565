"""Streams with timers: responses assembled from their chunks, and series that fall silent.

State is kept by `transformWithState` in lists and values with timers on event time, so a response's chunks wait, in
any order, until they are whole or nothing has come for so long; the session needs the RocksDB state store
(`use_rocksdb`). A response's state is its own chunks, and goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


class _Assembler(StatefulProcessor):
    """Chunks of one response: kept by number until the one that is marked as the last and all before it are there."""

    OUT = ["status", "text", "chunks", "missing", "first_text_at", "last_at"]

    def __init__(self, by: str, silence: float):
        self.by, self.silence = by, int(silence * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "number long, text string, done boolean, at long")
        self.ended = handle.getValueState("ended", "ended boolean")

    def _assembled(self, key: tuple, status: str, parts: dict[int, tuple]) -> pd.DataFrame:
        last = next((n for n, p in parts.items() if p[1]), max(parts))
        have = sorted(n for n in parts if n <= last)
        spoken = [parts[n][2] for n in have if parts[n][0]]
        row = (*key, status, "".join(parts[n][0] or "" for n in have), len(have), last + 1 - len(have), min(spoken, default=None), max(parts[n][2] for n in have))
        return _frame([row], [self.by, *self.OUT])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            for _ in rows:  # late chunks of a response that is out already
                pass
            return
        parts = {int(n): (t, d, int(at)) for n, t, d, at in self.parts.get()} if self.parts.exists() else {}
        for frame in rows:
            for n, t, d, at in zip(frame["number"], frame["text"], frame["done"], frame["at"], strict=True):
                if int(n) not in parts:  # a chunk that comes twice counts once
                    parts[int(n)] = (None if t is None or t is pd.NA or t != t else str(t), bool(d), int(at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = max(p[2] for p in parts.values())
        # The timer stays after the end too: it clears the mark that turns late chunks away.
        self.handle.registerTimer(max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.silence)
        last = next((n for n, p in parts.items() if p[1]), None)
        if last is not None and all(n in parts for n in range(last + 1)):
            self.parts.clear()
            self.ended.update((True,))
            yield self._assembled(key, "complete", parts)
        else:
            self.parts.put([(n, *p) for n, p in sorted(parts.items())])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.parts.exists():
            yield self._assembled(key, "incomplete", {int(n): (t, d, int(at)) for n, t, d, at in self.parts.get()})
            self.parts.clear()
        self.ended.clear()

    def close(self) -> None:
        pass


def assembled_responses(chunks: DataFrame, by: str = "request_id", time: str = "ts", number: str = "number", text: str = "text", done: str = "done", silence: float = 60.0, delay: str = "30 seconds") -> DataFrame:
    """(by, status, text, chunks, missing, first_text_at, last_at): a row for each streamed response, once.

    A response is complete when the chunk marked `done` and all chunks of lower numbers (from 0) have come, in whatever order;
    its text is in the chunks' order. One that gets nothing for `silence` seconds of event time is incomplete and comes out
    with what there is; `missing` counts the chunks that it lacks up to its last. Chunks that come again or late are left out.
    """
    rows = chunks.withWatermark(time, delay)
    rows = rows.select(by, F.col(time).alias("event_time"), F.col(number).cast("long").alias("number"), F.col(text).alias("text"), F.coalesce(F.col(done), F.lit(False)).alias("done"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    kind = chunks.schema[by].dataType.simpleString()
    out = f"{by} {kind}, status string, text string, chunks long, missing long, first_text_at long, last_at long"
    found = rows.groupBy(by).transformWithStateInPandas(_Assembler(by, silence), out, "append", "eventtime")
    return found.withColumn("first_text_at", F.timestamp_micros("first_text_at")).withColumn("last_at", F.timestamp_micros("last_at"))


class _Silence(StatefulProcessor):
    """One series: when its newest sample was, and a timer behind it."""

    def __init__(self, by: str, seconds: float):
        self.by, self.wait = by, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(frame["at"].max()) for frame in rows)
        if self.newest.exists():
            at = max(at, self.newest.get()[0])
        self.newest.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.wait)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.newest.get()[0]
        self.newest.clear()
        yield _frame([(*key, at, expiredTimerInfo.getExpiryTimeInMs() * 1000)], [self.by, "last_at", "raised_at"])

    def close(self) -> None:
        pass


def silence_alarms(samples: DataFrame, by: str, time: str, seconds: float, delay: str = "30 seconds") -> DataFrame:
    """(by, last_at, raised_at): a row each time a series gets no sample for so long, by event time; it may start again."""
    rows = samples.withWatermark(time, delay).select(by, F.col(time).alias("event_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    kind = samples.schema[by].dataType.simpleString()
    found = rows.groupBy(by).transformWithStateInPandas(_Silence(by, seconds), f"{by} {kind}, last_at long, raised_at long", "append", "eventtime")
    return found.withColumn("last_at", F.timestamp_micros("last_at")).withColumn("raised_at", F.timestamp_micros("raised_at"))
