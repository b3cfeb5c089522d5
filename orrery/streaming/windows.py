"""Windowed and stateful operators over streams; the windowed ones take batch tables as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.storage import ship


def _late(df: DataFrame, time: str, lateness: str) -> DataFrame:
    return df.withWatermark(time, lateness) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column], lateness: str = "10 minutes") -> DataFrame:
    """Aggregates by window and keys: start, end, keys, values. Rows later than `lateness` are dropped."""
    grouped = _late(df, time, lateness).groupBy(F.window(time, size), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window"])


def sliding(df: DataFrame, time: str, size: str, step: str, keys: list[str], aggregates: list[Column], lateness: str = "10 minutes") -> DataFrame:
    grouped = _late(df, time, lateness).groupBy(F.window(time, size, step), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], lateness: str = "10 minutes") -> DataFrame:
    grouped = _late(df, time, lateness).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in grouped.columns if c != "session_window"])


def deduplicated(df: DataFrame, time: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than `lateness` goes."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """After each micro-batch the keys that it touched, with count and sum so far (stream only)."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
