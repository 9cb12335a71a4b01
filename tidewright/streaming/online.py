"""Structured Streaming forms: counts of label transitions as they happen, and late readings on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_transitions(stream: DataFrame, key: str, order: str, label: str, late: str = "0 seconds") -> DataFrame:
    """key, label, next of each change of label, emitted once and in order of time.

    Rows may come in any order and up to ``late`` behind the latest row of the stream: they are held per key
    until the watermark has passed them. Later ones are dropped, as they cannot change what was emitted, so
    ``late`` must cover the stream's delay (0: rows of one batch only). Rows without a time take no part.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, times, labels = state.get if state.exists else (None, None, [], [])
        rows = list(zip(times, labels, strict=True))
        for b in batches:
            rows += zip(b["_o"].tolist(), b["_l"].tolist(), strict=True)
        rows.sort(key=lambda r: r[0])
        done = state.getCurrentWatermarkMs() * 1000
        out, held = [], []
        for o, v in rows:
            if o > done:
                held.append((o, v))
                continue
            if at is not None and o < at:
                continue
            if last is not None and v != last:
                out.append((k[0], last, v))
            last, at = v, int(o)
        state.update((last, at, [int(o) for o, _ in held], [v for _, v in held]))
        if held:  # a time-out comes once the watermark is beyond it, so it is set just before the row
            state.setTimeoutTimestamp(max(1, -(-int(held[0][0]) // 1000) - 1))
        yield pd.DataFrame(out, columns=["key", "label", "next"])

    x = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("timestamp").alias("_t"), F.col(label).alias("_l")).where(F.col("_t").isNotNull())
    x = x.withWatermark("_t", late).select("key", "_t", F.unix_micros("_t").alias("_o"), F.col("_l").cast("string").alias("_l"))
    return x.groupBy("key").applyInPandasWithState(step, "key string, label string, next string", "last string, at bigint, times array<bigint>, labels array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_mean(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean per key and window; a window is final once the watermark has passed it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "mean")
