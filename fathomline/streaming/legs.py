"""Legs of tracks as their fixes come in: Structured Streaming with a state for each track.

A fix waits in the state until the watermark has passed its time, for an earlier one may still come; then it is the end of the leg that began at the
track's last fix, which is given, and takes that one's place. So the stream's legs are those of ``operators.track.with_legs`` over all fixes that weren't
late, in order of time and id, but without the last fix's empty leg. Fixes behind the watermark are dropped by the engine, and it counts them. The state
holds one fix a track and those within the watermark's delay; a restarted query goes on from its checkpoint.

Defined cases: fixes without a time, a position or an id are left out before the state; fixes that tie in time and id are each an end of a leg.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geodesy import NM

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIX = "id bigint, micros bigint, lat double, lon double"


class Legs(StatefulProcessor):
    def __init__(self, radius: float):
        self.radius = radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", FIX)
        self.waiting = handle.getListState("waiting", FIX)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            self.waiting.appendList([(int(i), int(t), float(a), float(o)) for i, t, a, o in zip(frame["id"], frame["micros"], frame["lat"], frame["lon"])])
            latest = max(latest or 0, int(frame["micros"].max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((int(t), int(i), float(a), float(o)) for i, t, a, o in self.waiting.get()))
        ready = [x for x in waiting if x[0] < passed]
        if not ready:
            return
        self.waiting.put([(i, t, a, o) for t, i, a, o in waiting[len(ready) :]]) if len(ready) < len(waiting) else self.waiting.clear()
        fixes = ready
        if self.last.exists():
            i, t, a, o = self.last.get()
            fixes = [(int(t), int(i), float(a), float(o)), *ready]
        t, i, a, o = fixes[-1]
        self.last.update((i, t, a, o))
        if len(fixes) > 1:
            time, ids, lat, lon = (np.array(x) for x in zip(*fixes))
            up = self.radius * np.diff(np.radians(lat))
            right = self.radius * np.cos((np.radians(lat[1:]) + np.radians(lat[:-1])) / 2) * np.diff(np.radians(lon))
            bearing = np.degrees(np.mod(np.arctan2(right, up), 2 * np.pi))
            yield pd.DataFrame({"track": key[0], "id": ids[:-1], "to_id": ids[1:], "distance": np.hypot(up, right), "bearing": bearing, "delta_seconds": np.diff(time) / 1e6})


def stream_legs(fixes: DataFrame, delay: str = "1 hour", radius: float = NM) -> DataFrame:
    """track, id (of the fix where the leg begins), to_id, distance, bearing, delta_seconds, of a stream of fixes (track, id, time, lat, lon) that come at most ``delay`` late.

    The session has to name a state store that keeps several states by key (``PROVIDER``: ``ROCKS``) before the query starts."""
    known = fixes.filter("track is not null and id is not null and time is not null and lat is not null and lon is not null").withWatermark("time", delay)
    rows = known.select("track", "time", F.col("id").cast("long").alias("id"), F.unix_micros("time").alias("micros"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    out = f"track {fixes.schema['track'].dataType.simpleString()}, id bigint, to_id bigint, distance double, bearing double, delta_seconds double"
    return rows.groupBy("track").transformWithStateInPandas(Legs(radius), out, "Append", "EventTime")
