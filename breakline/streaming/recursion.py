"""The recursion itself as a stream's state: change points in the mean of series that never end.

A series' state is its length and sums, the live starts of the recursion with the least totals up to them and the sums
before them, and the back-pointers that live starts still lead to. What all live starts' paths share can no longer change:
it is given out and forgotten, so the state stays as small as what is undecided. Rows wait until the watermark has passed
them and are taken in order of event time, so the division into micro-batches does not matter; rows later than the
watermark are dropped by Spark, and rows at or before the last one taken are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "n long, s double, q double, last long, late long, starts array<long>, totals array<double>, sums array<double>, squares array<double>, nodes array<long>, backs array<long>, times array<long>, given long, cut long"
WAITING = "times array<long>, values array<double>"


class Recursion:
    """Least sums of mean costs with known noise, one row at a time."""

    def __init__(self, beta: float, noise: float, state: tuple | None = None):
        self.beta, self.noise = beta, noise
        if state is None:
            state = (0, 0.0, 0.0, None, 0, [0], [-beta], [0.0], [0.0], [0], [-1], [0], 0, 0)
        self.n, self.s, self.q, self.last, self.late = state[:5]
        self.starts, self.totals, self.sums, self.squares = (list(v) for v in state[5:9])
        self.back = dict(zip(state[9], state[10], strict=True))
        self.time = dict(zip(state[9], state[11], strict=True))
        self.given, self.cut = state[12], state[13]  # change points given out, and the last of them

    def state(self) -> tuple:
        nodes = list(self.back)
        return (self.n, self.s, self.q, self.last, self.late, self.starts, self.totals, self.sums, self.squares, nodes, [self.back[k] for k in nodes], [self.time[k] for k in nodes], self.given, self.cut)

    def take(self, time: int, value: float) -> None:
        if self.last is not None and time <= self.last:
            self.late += 1
            return
        if self.starts[-1] == self.n:
            self.time[self.n] = time  # a segment that starts here starts with this row
        self.n, self.s, self.q, self.last = self.n + 1, self.s + value, self.q + value * value, time
        starts, totals = np.array(self.starts), np.array(self.totals)
        length = self.n - starts
        s = self.s - np.array(self.sums)
        cost = totals + ((self.q - np.array(self.squares)) - s * s / length) / (2 * self.noise) + np.log(length) / 2
        best = int(np.argmin(cost))
        total = float(cost[best]) + self.beta
        # however long the series gets, the length terms of both parts exceed that of the whole by at most this
        keep = np.flatnonzero(cost <= total + np.log(length) / 2)
        for name in ("starts", "totals", "sums", "squares"):
            own = getattr(self, name)
            setattr(self, name, [own[k] for k in keep.tolist()])
        self.back[self.n] = int(starts[best])
        self.time[self.n] = time
        self.starts.append(self.n)
        self.totals.append(total)
        self.sums.append(self.s)
        self.squares.append(self.q)

    def path(self, node: int) -> list[int]:
        """Change points on the way to a node that have not been given out."""
        out = []
        while node > self.cut:
            out.append(node)
            node = self.back[node]
        return out[::-1]

    def decided(self) -> list[tuple[int, int]]:
        """(position, time of its first row) of the change points that all live starts' paths share; state is tidied."""
        paths = [self.path(k) for k in self.starts]
        common = []
        for nodes in zip(*paths, strict=False):
            if len(set(nodes)) > 1 or nodes[0] in (self.n, *self.starts[-1:]):
                break
            common.append(nodes[0])
        out = [(k, self.time[k]) for k in common]
        if common:
            self.cut, self.given = common[-1], self.given + len(common)
        live = {self.cut, *self.starts, *(k for p in paths for k in p)}
        self.back = {k: v for k, v in self.back.items() if k in live}
        self.time = {k: v for k, v in self.time.items() if k in live}
        return out

    def rest(self) -> list[tuple[int, int]]:
        """The change points not given out yet, of the rows so far."""
        return [(k, self.time[k]) for k in self.path(self.back[self.n]) if k > 0] if self.n > 1 else []


class _Detect(StatefulProcessor):
    def __init__(self, series: str, time: str, value: str, beta: float, noise: float, idle: int):
        self.names, self.beta, self.noise, self.idle = (series, time, value), beta, noise, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.waiting = handle.getValueState("recursion", STATE), handle.getValueState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, values = (list(v) for v in self.waiting.get()) if self.waiting.exists() else ([], [])
        for part in rows:
            times += (part[self.names[1]].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            values += part[self.names[2]].astype(float).tolist()
        self.waiting.update((times, values))
        yield self._taken(key, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        yield self._taken(key, mark, True)

    def _taken(self, key, mark: int, timer: bool) -> pd.DataFrame:
        times, values = (list(v) for v in self.waiting.get()) if self.waiting.exists() else ([], [])
        r = Recursion(self.beta, self.noise, self.held.get() if self.held.exists() else None)
        ready = sorted((t, v) for t, v in zip(times, values, strict=True) if t <= mark)
        for t, v in ready:
            r.take(t, v)
        left = [(t, v) for t, v in zip(times, values, strict=True) if t > mark]
        self.waiting.update(([t for t, _ in left], [v for _, v in left]))
        out = [(*x, "decided") for x in r.decided()] if ready else []
        if not left and r.last is not None and mark >= r.last + self.idle:  # the series has ended: what is left of its path
            out += [(*x, "ended") for x in r.rest()]
            self.held.clear()
            self.waiting.clear()
        else:
            self.held.update(r.state())
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(min(t for t, _ in left) if left else (r.last or mark) + self.idle)
        plain = lambda v: pd.Series(v, dtype=object)
        return pd.DataFrame({self.names[0]: plain([key[0]] * len(out)), "cp": np.array([c for c, _, _ in out], np.int64), "at": np.array([t for _, t, _ in out], "datetime64[ms]"), "why": plain([w for _, _, w in out])})

    def close(self) -> None:
        pass


def change_points(stream: DataFrame, series: str, time: str, value: str, beta: float, noise: float, idle_seconds: int) -> DataFrame:
    """(series, cp, at, why): change points in the mean, ``cp`` rows after a series' first and first seen at ``at``.

    ``stream`` has a watermark on ``time`` (a timestamp, unique within a series). A point is given out when no further row
    can move it ("decided"), and the others when the watermark is ``idle_seconds`` past a series' last row ("ended"; the
    state then goes, and a later row begins a new series). ``noise`` is the variance of the noise, which a stream cannot
    take from rows to come. Needs the RocksDB state store. Null values and times are left out.
    """
    kind = stream.schema[series].dataType.simpleString()
    rows = stream.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(series, time, value)
    out = f"`{series}` {kind}, cp long, at timestamp, why string"
    return rows.groupBy(series).transformWithStateInPandas(_Detect(series, time, value, beta, noise, idle_seconds * 1000), out, "Append", "EventTime")
