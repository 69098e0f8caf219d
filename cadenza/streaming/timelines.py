"""Timelines as streams: windowed activity, running smoothing and open spans.

Batch and stream share the rules; the stream keeps one small state per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SMOOTHED = "entity long, ts timestamp, value double, smoothed double"
SPANS = "entity long, start long, end long, length long"
TIMED = "entity long, start timestamp, end timestamp, rows long"


def windowed_activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and largest value per window and kind of ``ts, kind, value`` rows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window, "kind")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum per session of an entity."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def running_smoothing(events: DataFrame, keep: float = 0.80) -> DataFrame:
    """Exponential smoothing of ``entity, ts, value`` in order of arrival, then of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for v in rows["value"]:
            last = v if last is None else keep * last + (1.0 - keep) * v
            out.append(last)
        state.update((float(last),))
        yield pd.DataFrame({"entity": key[0], "ts": rows["ts"].to_numpy(), "value": rows["value"].to_numpy(), "smoothed": out})

    return events.groupBy("entity").applyInPandasWithState(step, SMOOTHED, "last double", "append", GroupStateTimeout.NoTimeout)


def closed_spans(events: DataFrame, least: int = 2, gap: int = 1) -> DataFrame:
    """Spans of ``entity, place, flag`` rows, given out once a later flag or place closes them."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end = state.get if state.exists else (-1, -1)
        out = []
        for place, flag in pd.concat(list(parts)).sort_values("place")[["place", "flag"]].itertuples(index=False):
            if start >= 0 and place - end > gap + 1:
                if end - start + 1 >= least:
                    out.append((key[0], start, end, end - start + 1))
                start, end = -1, -1
            if flag:
                start, end = (place if start < 0 else start), place
        state.update((int(start), int(end)))
        yield pd.DataFrame(out, columns=["entity", "start", "end", "length"])

    return events.groupBy("entity").applyInPandasWithState(step, SPANS, "start long, end long", "append", GroupStateTimeout.NoTimeout)


class _TimedSpans(StatefulProcessor):
    """The open span of an entity: its first and last flagged time and its rows.

    A timer stands at the time after which no row can join the span. When the watermark passes
    it, the span is given out and the entity's state is cleared, so only entities with an open
    span are kept.
    """

    def __init__(self, gap_ms: int, least: int) -> None:
        self.gap, self.least = gap_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "start long, end long, rows long, timer long")

    def _given(self, key: tuple, start: int, end: int, rows: int) -> Iterator[Row]:
        if rows >= self.least:
            at = lambda ms: pd.Timestamp(ms, unit="ms").to_pydatetime()
            yield Row(entity=key[0], start=at(start), end=at(end), rows=rows)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.span.get() if self.span.exists() else None
        start, end, n, timer = held if held else (None, None, 0, None)
        for ms in sorted(r["ms"] for r in rows):
            if start is not None and ms - end > self.gap:
                yield from self._given(key, start, end, n)
                start, n = None, 0
            start, end, n = (ms if start is None else start), ms if start is None else max(end, ms), n + 1
        due = end + self.gap + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.span.update((start, end, n, due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.span.exists():
            start, end, n, timer = self.span.get()
            if timer <= expiredTimerInfo.getExpiryTimeInMs():
                self.span.clear()
                yield from self._given(key, start, end, n)

    def close(self) -> None:
        pass


def timed_spans(events: DataFrame, gap: float = 2.0, least: int = 2, late: str = "1 second") -> DataFrame:
    """Runs of flagged ``entity, ts, flag`` rows at most ``gap`` seconds apart, given out once a
    later row or the watermark closes them. Times are UTC; needs a state store with timers
    (``spark.sql.streaming.stateStore.providerClass`` for RocksDB)."""
    rows = events.withWatermark("ts", late).where("flag").select("entity", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("entity").transformWithState(_TimedSpans(int(gap * 1000), least), TIMED, "append", "eventTime")
