"""Incremental edge counts of a stream of track positions (an extension: the batch library has no streams)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "trackid string, time timestamp, orig long, dest long"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of a track's new positions with the position before; the last position is the state. Idle tracks are forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(parts)).sort_values("time", kind="stable")
    at, last = state.get if state.exists else (None, None)
    out = []
    for t, cell in rows[["time", "cell"]].itertuples(index=False):
        if at is not None and t.value <= at:
            continue  # later than what the state has seen
        if last is not None:
            out.append((key[0], t, last, int(cell)))
        at, last = t.value, int(cell)
    if last is not None:
        state.update((at, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), rows["time"].max().value // 1_000_000) + 30 * 86_400_000)
    yield pd.DataFrame(out, columns=["trackid", "time", "orig", "dest"])


def stream_pairs(positions: DataFrame, late: str = "1 day") -> DataFrame:
    """Origin-destination pairs of a stream (trackid, time, cell); positions later than ``late`` are dropped."""
    some = positions.where("cell IS NOT NULL").select(F.col("trackid").cast("string"), "time", F.col("cell").cast("long")).withWatermark("time", late)
    return some.groupBy("trackid").applyInPandasWithState(_step, PAIR, "at long, cell long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_edges(positions: DataFrame, window: str = "30 days", late: str = "1 day") -> DataFrame:
    """(window, orig, dest, cnt) over event-time windows, emitted once a window is closed by the watermark."""
    got = stream_pairs(positions, late)
    return got.groupBy(F.window("time", window), "orig", "dest").agg(F.count(F.lit(1)).alias("cnt"))
