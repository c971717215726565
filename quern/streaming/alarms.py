"""Streaming twins of the telemetry alarms and extremes.

Samples of a series are taken in order of their time within a micro-batch; a sample older than the series' last
one is late and is left out, as the sampled source never reorders. State is one small record for each series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def consecutive_alarms(samples: DataFrame, by: str, time: str, breach: str, least: int = 5) -> DataFrame:
    """A row (by, raised_at, samples) when a series breaches for the `least`th time running; recovery starts over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, -1)
        out = []
        for row in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            if row.at < last:
                continue
            last = int(row.at)
            count = count + 1 if row.breach else 0
            if count == least:
                out.append((key[0], row.at, count))
        state.update((count, last))
        yield pd.DataFrame(out, columns=[by, "raised_at_us", "samples"])

    kind = samples.schema[by].dataType.simpleString()
    rows = samples.select(by, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.coalesce(F.col(breach), F.lit(False)).alias("breach"))
    found = rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, raised_at_us long, samples int", "count int, last long", "append", GroupStateTimeout.NoTimeout)
    return found.select(by, F.timestamp_micros("raised_at_us").alias("raised_at"), "samples")


def sustained_alarms(samples: DataFrame, by: str, time: str, reasons: str, seconds: float) -> DataFrame:
    """A row (by, started, raised_at, reasons) once a breach has lasted so long; recovery starts over.

    `reasons` names a column with the joined reasons of a sample, empty or null for a sound one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, raised, last = state.get if state.exists else (-1, False, -1)
        out = []
        for row in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            if row.at < last:
                continue
            last = int(row.at)
            if not row.reasons:
                since, raised = -1, False
                continue
            since = last if since < 0 else since
            if not raised and last - since >= seconds * 1e6:
                raised = True
                out.append((key[0], since, last, row.reasons))
        state.update((since, raised, last))
        yield pd.DataFrame(out, columns=[by, "started_us", "raised_us", "reasons"])

    kind = samples.schema[by].dataType.simpleString()
    rows = samples.select(by, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.coalesce(F.col(reasons), F.lit("")).alias("reasons"))
    found = rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, started_us long, raised_us long, reasons string", "since long, raised boolean, last long", "append", GroupStateTimeout.NoTimeout)
    return found.select(by, F.timestamp_micros("started_us").alias("started"), F.timestamp_micros("raised_us").alias("raised_at"), "reasons")


def running_extremes(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Least and largest value and the number of samples so far; written in update or complete mode."""
    return samples.groupBy(by).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count("*").alias("samples"))
