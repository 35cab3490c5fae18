"""Streaming forms: active periods by session windows, and candidate segments by a stateful processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENT = "slot string, segment long, start_us long, end_us long, log_count long"
STATE = "segment long, start_us long, end_us long, log_count long"


def streaming_periods(stamps: DataFrame, slot: str, ts: str, gap_seconds: int, late: str) -> DataFrame:
    """(slot, start, end, n) per active period: a larger gap than the threshold ends it; rows later than ``late`` are dropped."""
    sessions = stamps.withWatermark(ts, late).groupBy(slot, F.session_window(ts, f"{gap_seconds} seconds"))
    return sessions.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).drop("session_window")


def streaming_segments(entries: DataFrame, ts: str, late: str, gap_seconds: int = 30) -> DataFrame:
    """Closed candidate segments of each slot: a gap of ``gap_seconds`` or more ends one.

    The state of a slot is the number of its next segment and, if there is one, its open segment; the number
    stays for as long as the query runs, so (slot, segment) names one segment but for -1.  It is emitted when a row behind the gap comes, or when the
    watermark has passed its end by the gap.  Rows of one micro-batch are sorted; rows that come so late
    that their segment is closed are counted to the open one if they are near it, else they are a
    segment of their own with the number -1.  Rows without a time are left out; rows behind the watermark
    are dropped by Spark, whose progress reports count them.
    """
    gap = gap_seconds * 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        segment, start, end, count = state.get if state.exists else (0, None, None, 0)
        if state.hasTimedOut:
            state.update((segment + 1, None, None, 0))
            yield pd.DataFrame([(key[0], segment, start, end, count)], columns=["slot", "segment", "start_us", "end_us", "log_count"])
            return
        stamps = sorted(int(v) for p in parts for v in p["ts_us"])
        for v in stamps:
            if start is None:
                start, end, count = v, v, 1
            elif v - end >= gap or start - v >= gap:
                if v > end:
                    done.append((key[0], segment, start, end, count))
                    segment, start, end, count = segment + 1, v, v, 1
                else:
                    done.append((key[0], -1, v, v, 1))
            else:
                start, end, count = min(start, v), max(end, v), count + 1
        state.update((segment, start, end, count))
        state.setTimeoutTimestamp(max(end // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["slot", "segment", "start_us", "end_us", "log_count"])

    rows = entries.filter(F.col(ts).isNotNull()).withWatermark(ts, late).withColumn("ts_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy("slot").applyInPandasWithState(run, SEGMENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
