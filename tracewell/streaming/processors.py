"""State machines of the streaming detectors.

Rows come as (ms, seq, kind, event_time, event_json) per key, where ``kind`` names the steps or the
event type. The event-time machines hold rows back until the watermark has passed them and then take
them in (ms, seq) order, so arrival order within the watermark delay does not matter; rows later
than that are dropped and counted by Spark.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = ["ms", "seq", "kind", "event_time", "event_json"]
#: Held rows are kept as JSON lists of so many: a state entry costs far more than its bytes.
CHUNK = 500
ROW = "ms long, seq long, kind string, event_time string, event_json string"
OUTPUT = "detected_at string, violation_type string, source_json array<string>"


def _frame(names: list[str], key, found: list[tuple]) -> pd.DataFrame:
    columns = [*names, "detected_at", "violation_type", "source_json"]
    return pd.DataFrame([(*key, *row) for row in found], columns=columns)


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    return [row for frame in frames for row in zip(*[frame[c].tolist() for c in INPUT])]


def _packed(rows: list[tuple]) -> list[tuple[str]]:
    return [(json.dumps(rows[at : at + CHUNK]),) for at in range(0, len(rows), CHUNK)]


def _unpacked(entries: Iterator[tuple[str]]) -> list[tuple]:
    return [tuple(row) for entry in entries for row in json.loads(entry[0])]


class EventTimeProcessor(StatefulProcessor):
    """Base: buffers rows and hands them to ``advance`` in event-time order.

    Every call to the state store is a round trip, and every entry is pickled with its schema, so both are few per key.
    """

    def __init__(self, key_names: list[str]):
        self.key_names = key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "body string")
        self.progress = handle.getValueState("progress", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = _rows(rows)
        if arrived:
            self.buffer.appendList(_packed(arrived))
            self._wake_at(min(r[0] for r in arrived))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = sorted(_unpacked(self.buffer.get()))
        ready = [r for r in held if r[0] <= watermark]
        rest = held[len(ready) :]
        before = self.progress.get()
        state = self.start() if before is None else json.loads(before[0])
        found = [m for row in ready for m in self.advance(state, row)]
        found += self.expire(state, watermark)
        after = None if state == self.start() else (json.dumps(state),)
        if after is not None:
            self.progress.update(after)
        elif before is not None:
            self.progress.clear()
        if ready and rest:
            self.buffer.put(_packed(rest))
        elif ready:
            self.buffer.clear()
        due = [r[0] for r in rest]
        if self.deadline(state) is not None:
            due.append(self.deadline(state))
        for timer in list(self.handle.listTimers()):
            if timer != expiredTimerInfo.getExpiryTimeInMs():  # Spark removes this one itself
                self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due))
        if found:
            yield _frame(self.key_names, key, found)

    def _wake_at(self, time: int) -> None:
        """Keep one timer per key, at the earliest time something is due."""
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= time:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(time)

    def start(self) -> dict:
        raise NotImplementedError

    def advance(self, state: dict, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def expire(self, state: dict, watermark: int) -> list[tuple]:
        return []

    def deadline(self, state: dict) -> int | None:
        return None

    def close(self) -> None:
        pass


class SequenceProcessor(EventTimeProcessor):
    """Ordered steps within a time limit; a match clears every attempt that began before its end.

    ``kind`` lists the steps a row satisfies, as comma-separated names. State is the positions of the rows of
    each step since the last match, in order, and the payload of each such row once, in a map. A row that satisfies
    the last step looks for the earliest start still in time and, from there, for the next row of each step: a
    binary search per step, however many attempts are open. Later starts cannot end earlier.
    """

    def __init__(self, key_names: list[str], steps: list[str], within_ms: int):
        super().__init__(key_names)
        self.steps = steps
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.payload = handle.getMapState("payload", "ms long, seq long", "event_json string")
        self.fresh: dict[tuple, str] = {}

    def start(self) -> dict:
        return {"rows": [[] for _ in self.steps[1:]]}

    def advance(self, state, row):
        ms, seq, kind, event_time, event_json = row
        satisfied, rows = set(kind.split(",")), state["rows"]
        if self.steps[-1] in satisfied:
            chain = self._chain(rows, ms)
            if chain is not None:
                found = [*[self._event(at) for at in chain], event_json]
                self._forget(rows, [len(r) for r in rows])
                return [(event_time, None, found)]
        began = bool(rows[0])
        for i, step in enumerate(self.steps[:-1]):
            if step in satisfied and (began or i == 0):
                rows[i].append([ms, seq])
                self.fresh[ms, seq] = event_json
        return []

    def _chain(self, rows: list[list], ms: int) -> list | None:
        """The first start after ``ms`` less the limit, and the first row of each next step after the one before."""
        chain, after = [], [ms - self.within_ms, math.inf]
        for own in rows:
            at = bisect_right(own, after)
            if at == len(own):
                return None
            after = own[at]
            chain.append(after)
        return chain

    def _event(self, at: list) -> str:
        fresh = self.fresh.get(tuple(at))
        return fresh if fresh is not None else self.payload.getValue(tuple(at))[0]

    def _forget(self, rows: list[list], counts: list[int]) -> None:
        gone = {tuple(at) for own, n in zip(rows, counts) for at in own[:n]}
        for own, n in zip(rows, counts):
            del own[:n]
        held = {tuple(at) for own in rows for at in own}
        for at in gone - held:
            if self.fresh.pop(at, None) is None:
                self.payload.removeKey(at)

    def expire(self, state, watermark):
        rows = state["rows"]
        first = bisect_right(rows[0], [watermark - self.within_ms, math.inf])
        begun = rows[0][first] if first < len(rows[0]) else [math.inf]
        self._forget(rows, [first, *[bisect_right(own, begun) for own in rows[1:]]])
        for at, event_json in self.fresh.items():
            self.payload.updateValue(at, (event_json,))
        self.fresh = {}
        return []

    def deadline(self, state):
        # Wakes up to forget starts that timed out, so that idle keys hold no state.
        return state["rows"][0][0][0] + self.within_ms if state["rows"][0] else None


class OrderFlowProcessor(EventTimeProcessor):
    """The three order-flow violations of one order; ``kind`` is the event type."""

    def __init__(self, key_names: list[str], window_ms: int, retain_ms: int | None = None):
        super().__init__(key_names)
        self.window_ms = window_ms
        self.retain_ms = retain_ms

    def start(self) -> dict:
        return {"seen": False, "order": None, "shipped": False, "waiting": None, "last": None}

    def advance(self, state, row):
        ms, _, kind, event_time, event_json = row
        # Only a delivery answers a waiting order, in time or not; without one the deadline's timer does.
        found = self._overdue(state, ms - 1) if kind in ("order", "shipment") else []
        state["last"] = max(ms, state["last"] or ms)
        event = {"ms": ms, "time": event_time, "json": event_json}
        if kind == "order":
            state.update(seen=True, order=event, shipped=False, waiting=event)
        elif kind == "shipment":
            if not state["seen"]:
                found.append((event_time, "shipment_without_order", [event_json]))
            state.update(seen=True, shipped=True, waiting=None)
        elif kind == "invoice":
            order = state["order"]
            if order is not None and not state["shipped"]:
                found.append((event_time, "invoice_without_shipment", [order["json"], event_json]))
            state.update(order=None, shipped=False)
        return found

    def _overdue(self, state, now: int) -> list[tuple]:
        """An event exactly at the deadline is still in time."""
        waiting = state["waiting"]
        if waiting is None or now < waiting["ms"] + self.window_ms:
            return []
        state["waiting"] = None
        return [(waiting["time"], "order_unfulfilled", [waiting["json"]])]

    def expire(self, state, watermark):
        # Rows up to the watermark are in, so a deadline before it can no longer be met.
        found = self._overdue(state, watermark)
        quiet = state["last"] is not None and self.retain_ms is not None
        if quiet and state["waiting"] is None and watermark >= state["last"] + self.retain_ms:
            state.update(self.start())
        return found

    def deadline(self, state):
        times = []
        if state["waiting"] is not None:
            times.append(state["waiting"]["ms"] + self.window_ms)
        elif self.retain_ms is not None and state["last"] is not None:
            times.append(state["last"] + self.retain_ms)
        return min(times, default=None)


class ArrivalFlowProcessor(OrderFlowProcessor):
    """The same rules with the events of an order taken as they arrive; only deadlines wait for event time.

    Nothing is held back and nothing comes too late: a row older than the watermark counts like any other.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(_rows(rows), key=lambda r: r[1])
        state = self._state()
        found = [m for row in arrived for m in self.advance(state, row)]
        yield from self._close(key, state, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        yield from self._close(key, state, self.expire(state, timerValues.getCurrentWatermarkInMs()))

    def _state(self) -> dict:
        return json.loads(self.progress.get()[0]) if self.progress.exists() else self.start()

    def _close(self, key, state: dict, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if state == self.start():
            self.progress.clear()
        else:
            self.progress.update((json.dumps(state),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.deadline(state) is not None:
            self.handle.registerTimer(self.deadline(state))
        if found:
            yield _frame(self.key_names, key, found)


class DeadlineProcessor(EventTimeProcessor):
    """Steps that their next step does not follow in time, for each (step, next, limit); a repeated step restarts its clock."""

    def __init__(self, key_names: list[str], deadlines: list[tuple[str, str, int]]):
        super().__init__(key_names)
        self.deadlines = deadlines

    def start(self) -> dict:
        return {"waiting": [None] * len(self.deadlines)}

    def advance(self, state, row):
        ms, _, kind, event_time, event_json = row
        found = []
        for i, (step, following, _) in enumerate(self.deadlines):
            if kind in (step, following):
                found += self._overdue(state, i, ms - 1)
                state["waiting"][i] = [ms, event_time, event_json] if kind == step else None
        return found

    def _overdue(self, state, i: int, now: int) -> list[tuple]:
        waiting, (step, following, limit) = state["waiting"][i], self.deadlines[i]
        if waiting is None or now < waiting[0] + limit:
            return []
        state["waiting"][i] = None
        return [(waiting[1], f"{step}:{following}", [waiting[2]])]

    def expire(self, state, watermark):
        return [m for i in range(len(self.deadlines)) for m in self._overdue(state, i, watermark)]

    def deadline(self, state):
        due = [w[0] + limit for w, (_, _, limit) in zip(state["waiting"], self.deadlines) if w is not None]
        return min(due, default=None)


class GapProcessor(StatefulProcessor):
    """Gaps between successive signals in arrival order; needs no watermark."""

    def __init__(self, key_names: list[str], threshold_seconds: int):
        self.key_names = key_names
        self.threshold_seconds = threshold_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        previous = tuple(self.last.get()) if self.last.exists() else None
        arrived = sorted(_rows(rows), key=lambda r: r[1])
        found = []
        for row in arrived:
            if previous is not None and int((row[0] - previous[0]) / 1000) > self.threshold_seconds:
                found.append((row[3], None, [previous[4]]))
            previous = row
        if arrived:
            self.last.update(previous)
        if found:
            yield _frame(self.key_names, key, found)

    def close(self) -> None:
        pass
