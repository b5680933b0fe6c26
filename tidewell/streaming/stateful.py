"""Per-key limits with state that ends: a typed state for each key and event-time timers that flush and clear it.

State is as large as the keys of the last minutes: a timer clears a key when nothing in it
can matter any more.  Rows older than the watermark are late: their key's state may be gone,
so they are refused, not counted.  Within a micro-batch a key's times are sorted as plain
arrays; a micro-batch bounds them (maxFilesPerTrigger and the like).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The provider of state that keeps typed states and timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _sorted_rows(frames: Iterator[pd.DataFrame], watermark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(microseconds, event ids, late) of a key's rows in order of time and id."""
    parts = [(f["us"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64)) for f in frames]
    us, ids = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((ids, us))
    return us[order], ids[order], us[order] < watermark * 1000


class RateLimit(StatefulProcessor):
    """(key, event_id, accepted): at most `most` accepted rows of a key in any `seconds`; refused and late ones do not count."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.span = most, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = sorted(r[0] for r in self.held.get()) if self.held.exists() else []
        us, ids, late = _sorted_rows(rows, timerValues.getCurrentWatermarkInMs())
        accepted = np.zeros(len(us), bool)
        for i, (t, old) in enumerate(zip(us.tolist(), late.tolist())):
            if old:
                continue
            held = [h for h in held if h > t - self.span]
            if len(held) < self.most:
                accepted[i] = True
                held.append(t)
        if held:
            self.held.put([(h,) for h in held])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "event_id": ids, "accepted": accepted})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "accepted": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


class AccessFlush(StatefulProcessor):
    """(key, accesses, flushed_us): accesses that count (none within `cooldown` of the last that did), together for `flush` seconds from the first."""

    def __init__(self, cooldown: float, flush: float) -> None:
        self.cooldown, self.flush = int(cooldown * 1_000_000), int(flush * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("access", "last long, pending long, due long")

    def _out(self, key: tuple, flushed: list[tuple[int, int]]) -> pd.DataFrame:
        n, at = (np.array([f[i] for f in flushed], np.int64) for i in (0, 1))
        return pd.DataFrame({"key": np.full(len(flushed), key[0], np.int64), "accesses": n, "flushed_us": at})

    def _keep(self, last: int, pending: int, due: int) -> None:
        self.state.update((last, pending, due))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # The flush comes first; the key itself ends with its cooldown.
        self.handle.registerTimer((due if pending else last + self.cooldown) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, pending, due = self.state.get() if self.state.exists() else (None, 0, 0)
        us, _, late = _sorted_rows(rows, timerValues.getCurrentWatermarkInMs())
        flushed = []
        for t in us[~late].tolist():
            if pending and t >= due:
                flushed.append((pending, due))
                pending = 0
            if last is None or t - last >= self.cooldown:
                last, pending, due = t, pending + 1, due if pending else t + self.flush
        if last is not None:
            self._keep(last, pending, due)
        yield self._out(key, flushed)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        flushed = []
        if self.state.exists():
            last, pending, due = self.state.get()
            if pending:
                flushed.append((pending, due))
            if (last + self.cooldown) // 1000 < timerValues.getCurrentWatermarkInMs():
                self.state.clear()
            else:
                self._keep(last, 0, 0)
        yield self._out(key, flushed)

    def close(self) -> None:
        pass


def keyed(events: DataFrame, key: object, late: str) -> DataFrame:
    """(key, event_id, ts, us) of events, with a watermark `late` behind their time."""
    return events.withWatermark("ts", late).select(key.cast("long").alias("key"), "event_id", "ts", F.unix_micros("ts").alias("us"))


def limited(events: DataFrame, key: object, most: int, seconds: float, late: str) -> DataFrame:
    return keyed(events, key, late).groupBy("key").transformWithStateInPandas(RateLimit(most, seconds), "key long, event_id long, accepted boolean", "append", "EventTime")


def flushed_accesses(events: DataFrame, key: object, cooldown: float = 300.0, flush: float = 5.0, late: str = "1 hour") -> DataFrame:
    return keyed(events, key, late).groupBy("key").transformWithStateInPandas(AccessFlush(cooldown, flush), "key long, accesses long, flushed_us long", "append", "EventTime")
