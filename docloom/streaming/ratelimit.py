"""Admission and eviction as Structured Streaming operators (R1, R7): state by key, time-to-live and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.ratelimit import BURST, MINUTE, Counters

OUT = "rate_key string, id long, allowed boolean, retry_after int, remaining int"
EVICTED = "connection string, opened timestamp, evicted timestamp, beats long"


class _Admission(StatefulProcessor):
    """Four numbers a key, gone when the key was idle for the longer window."""

    def __init__(self, burst: tuple[int, int], minute: tuple[int, int]):
        self.burst, self.minute = burst, minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        idle = max(self.burst[1], self.minute[1]) // 1000
        self.state = handle.getValueState("counters", "bs long, bc long, ms long, mc long", ttlDurationMs=idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counters = Counters(self.burst, self.minute, tuple(self.state.get()) if self.state.exists() else (-1, 0, -1, 0))
        # one key's requests of one trigger, two numbers each, as they must be counted in the order of time
        every = pd.concat([r[["us", "id"]] for r in rows]).sort_values(["us", "id"])
        # Without a time a request cannot be counted and is let in
        out = [(key[0], i, *((True, 0, self.minute[0]) if pd.isna(t) else counters.hit(int(t)))) for t, i in zip(every["us"], every["id"])]
        self.state.update(counters.state)
        yield pd.DataFrame(out, columns=["rate_key", "id", "allowed", "retry_after", "remaining"])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, key: str, ts: str, order: str, burst=BURST, minute=MINUTE) -> DataFrame:
    """Requests (key, ts, order) to decisions, equal to the batch form's if a key's requests arrive in time order.

    State lives as long as the longer window after a key's last request (processing time)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.select(F.col(key).cast("string").alias("rate_key"), us.alias("us"), F.col(order).cast("long").alias("id"))
    return rows.groupBy("rate_key").transformWithStateInPandas(_Admission(burst, minute), OUT, "Append", "ProcessingTime")


class _Sessions(StatefulProcessor):
    """A connection's open sessions (first beat -> last beat and number), and one timer for the one that ends first."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "opened long", "last long, beats long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.open.iterator()}
        before = dict(held)
        for batch in rows:  # one batch at a time; beats may come in any order, so a beat can also join two sessions
            for t in batch["us"].dropna().astype("int64"):
                near = [s for s, (last, _) in held.items() if s - self.idle <= t <= last + self.idle]
                merged = [(s, *held.pop(s)) for s in near] + [(t, t, 1)]
                held[int(min(s for s, _, _ in merged))] = (int(max(e for _, e, _ in merged)), sum(n for _, _, n in merged))
        for s in before.keys() - held.keys():
            self.open.removeKey((s,))
        for s, v in held.items():
            if before.get(s) != v:
                self.open.updateValue((s,), v)
        self._wait(held)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.open.iterator()}
        done = [(s, last, n) for s, (last, n) in held.items() if self._ends(last) <= now]
        for s, _, _ in done:
            self.open.removeKey((s,))
            del held[s]
        self._wait(held)
        yield self._rows(key, done)

    def _ends(self, last: int) -> int:
        return -(-(last + self.idle) // 1000)

    def _wait(self, held: dict[int, tuple[int, int]]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if held:
            self.handle.registerTimer(min(self._ends(last) for last, _ in held.values()))

    def _rows(self, key, done: list[tuple[int, int, int]]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], s, last + self.idle, n) for s, last, n in sorted(done)], columns=["connection", "opened", "evicted", "beats"])
        return out.assign(opened=pd.to_datetime(out["opened"], unit="us"), evicted=pd.to_datetime(out["evicted"], unit="us"), beats=out["beats"].astype("int64"))

    def close(self) -> None:
        pass


def stale_connections(heartbeats: DataFrame, idle_seconds: float = 10.0, late: str = "10 seconds") -> DataFrame:
    """Heartbeats (connection, ts) -> (connection, opened, evicted, beats): a connection is evicted when it was idle for longer than `idle_seconds`.

    Event time decides, by a timer at the last beat and the idle time: a row comes when the watermark (the latest beat less `late`) has passed it. Beats may come late up to the
    watermark, in any order and repeatedly; a beat exactly `idle_seconds` after the last one still belongs to it. Beats without a time or behind the watermark are left
    out. State is one row for each open session, and goes with it."""
    rows = heartbeats.where("ts is not null").withWatermark("ts", late).select(F.col("connection").cast("string").alias("connection"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("connection").transformWithStateInPandas(_Sessions(round(idle_seconds * 1_000_000)), EVICTED, "Append", "EventTime")
