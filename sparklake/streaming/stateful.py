"""Event-time operators. Event times must be TIMESTAMP: cast TIMESTAMP_NTZ first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, at: str, delay: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Rows in each closed window and key: window_start, window_end, keys, n."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counts = stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_counts(stream: DataFrame, at: str, delay: str, gap: str, key: str, kind: str) -> DataFrame:
    """Sessions of a key that end after ``gap``: times, duration, events and kinds of events (a distinct count that streams allow)."""
    found = stream.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("event_count"), F.size(F.collect_set(kind)).alias("event_type_count"), F.max(at).alias("_last"))
    seconds = (F.unix_micros("_last") - F.unix_micros("w.start")) / 1_000_000
    return found.select(key, F.col("w.start").alias("session_start"), F.col("_last").alias("session_end"), seconds.alias("session_duration_s"), "event_count", "event_type_count")


def first_seen(stream: DataFrame, at: str, delay: str, *keys: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them, so a late copy may come again."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, delay: str, within: str, how: str = "inner") -> DataFrame:
    """Pairs of a key where the right row follows within an interval; for outer joins, unmatched rows come once the watermark allows."""
    a, b = left.withWatermark(left_at, delay), right.withWatermark(right_at, delay)
    on = (a[key] == b[f"right_{key}"]) & (b[right_at] >= a[left_at]) & (b[right_at] <= a[left_at] + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "left_outer" if how == "left" else how)


def chain_join(streams: list[DataFrame], key: str, at: list[str], delay: str, within: str) -> DataFrame:
    """Rows of several streams that follow one another within an interval each: an inner join in a chain, every side with its watermark.

    The first stream has ``key``, the k-th one ``key_k`` (k from 1); ``at`` names their times.
    """
    out = streams[0].withWatermark(at[0], delay)
    for k, stream in enumerate(streams[1:], 1):
        right, before, now = stream.withWatermark(at[k], delay), F.col(at[k - 1]), F.col(at[k])
        out = out.join(right, (F.col(key) == F.col(f"{key}_{k}")) & (now >= before) & (now <= before + F.expr(f"INTERVAL {within}")))
    return out


def custom_sessions(stream: DataFrame, key: str, at: str, delay: str, gap_seconds: float) -> DataFrame:
    """Sessions by arbitrary state: open (start, last, n) intervals of a key are merged as rows arrive in any order and emitted when the
    watermark passes their end. Rows: key, session_start, session_end, n (times in seconds)."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            opened += [(t, t, 1) for t in batch["_t"]]
        opened.sort()
        merged: list[tuple] = []
        for start, last, n in opened:
            if merged and start - merged[-1][1] <= gap_seconds:
                a, z, m = merged[-1]
                merged[-1] = (a, max(z, last), m + n)
            else:
                merged.append((start, last, n))
        passed = state.getCurrentWatermarkMs() / 1000
        closed = [s for s in merged if s[1] + gap_seconds < passed]
        left = [s for s in merged if s[1] + gap_seconds >= passed]
        if left:
            state.update(tuple(list(x) for x in zip(*left, strict=True)))
            state.setTimeoutTimestamp(max(int((left[0][1] + gap_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({key: keys[0], "session_start": [s[0] for s in closed], "session_end": [s[1] for s in closed], "n": [s[2] for s in closed]})

    kind = dict(stream.dtypes)[key]
    timed = stream.withWatermark(at, delay).withColumn("_t", F.unix_micros(at) / F.lit(1_000_000.0))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, session_start double, session_end double, n long", "starts array<double>, lasts array<double>, ns array<long>", "append", GroupStateTimeout.EventTimeTimeout)
