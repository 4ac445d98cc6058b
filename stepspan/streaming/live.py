"""The live state of facilities on event-time timers: statuses come into force, end, and are forgotten without a message.

Needs the RocksDB state store, which run_available(state_store=ROCKSDB) sets for the run of the stream.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "lift bigint, at_us bigint, status string, shown string, since_us bigint"
_MINUTE = 60_000_000
#: Stands for no start and no time.
_NEVER = -(2**62)


class Facility(StatefulProcessor):
    """STR-1, STR-2 of one lift. Time goes on with the messages' times and, between them, with the watermark: whatever happens
    by itself (a start in the future, an end, the end of a hold, silence) has a timer, one at a time. The state is one row with the
    conditions since the last full state in it, so that a lift's batch costs one read and one write; after `forget` minutes without a
    message it is dropped. In a batch a message costs the logarithm of the conditions held: `starts` has those that have not ended,
    in order, `times` is a heap of the starts and ends to come. Rows, not frames: most lifts have few messages in a batch, and a frame
    costs more than they do."""

    def __init__(self, keep: int | None, hold_minutes: int, forget_minutes: int) -> None:
        self.keep, self.hold, self.forget = keep, hold_minutes * _MINUTE, forget_minutes * _MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "now_us bigint, full_us bigint, seen_us bigint, back_us bigint, status string, shown string, timer_ms bigint, held string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        told: list[tuple] = []
        messages = sorted((json.loads(x[1]) for x in rows), key=lambda m: (m["received"], m["id"]))
        for m in messages:
            i, status, received = m["id"], m.get("status"), m["received"]
            start, end, full = m.get("start", _NEVER), m.get("end", _NEVER), m["full"]
            told += self._until(received)
            if self.now == _NEVER:  # forgotten, or first seen
                self.seen = received
            self.now, self.seen = max(self.now, received), max(self.seen, received)
            if full:
                self.full = max(self.full, received)
                for s in [s for s, h in self.held.items() if h[3] < self.full]:
                    self._drop(s)
            before = self.held.get(start)
            if received >= self.full and (before is None or (before[3], before[0]) < (received, i)):
                self._hold(start, (i, status, end, received))
            told += self._evaluate(self.now)
        yield from self._saved(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.timer = _NEVER
        # a timer that is set here would wait for the next batch, so time goes on to the watermark at once
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield from self._saved(key, self._until(end * 1000))

    def _load(self) -> None:
        self.now, self.full, self.seen, self.back, self.status, self.shown, self.timer, held = self.clock.get() or (_NEVER,) * 4 + (None, "new", _NEVER, "[]")
        self.held, self.starts, self.times = {}, [], []
        for start, *h in json.loads(held):
            self.held[start] = tuple(h)
            if h[2] == _NEVER or h[2] > self.now:
                self.starts.append(start)
            self.times += [(t, start) for t in (start, h[2]) if t > self.now]
        self.starts.sort()
        heapify(self.times)

    def _hold(self, start: int, condition: tuple) -> None:
        """A resend takes the place of what was held with its start."""
        self.held[start] = condition
        at = bisect_left(self.starts, start)
        if self.starts[at : at + 1] != [start]:
            self.starts.insert(at, start)
        for t in (start, condition[2]):
            if t > self.now:
                heappush(self.times, (t, start))
        if self.keep is not None and len(self.held) > self.keep:
            self._drop(min(self.held))

    def _drop(self, start: int) -> None:
        del self.held[start]
        at = bisect_left(self.starts, start)
        if self.starts[at : at + 1] == [start]:
            del self.starts[at]

    def _current(self, now: int) -> str | None:
        """The status of the condition that started last among those valid now. Time goes on, so what has ended stays out of starts."""
        while at := bisect_right(self.starts, now):
            _, status, end, _ = self.held[self.starts[at - 1]]
            if end == _NEVER or end > now:
                return status
            del self.starts[at - 1]
        return "unknown"

    def _evaluate(self, now: int) -> list[tuple]:
        """The row that tells of a change at this time, if there is one."""
        status = self._current(now)
        if status == "available" and self.status not in (None, "available"):
            self.back = now
        self.status = status
        held_back = status == "available" and self.back != _NEVER and now - self.back < self.hold
        shown = status if status != "available" else "back" if held_back else None
        if shown == self.shown:
            return []
        self.shown = shown
        return [(now, status, shown, self.back if held_back else None)]

    def _next(self) -> int | None:
        """When something happens by itself."""
        if self.now == _NEVER:
            return None
        while self.times and (self.times[0][0] <= self.now or self._stale(*self.times[0])):
            heappop(self.times)
        times = [t for t, _ in self.times[:1]]
        if self.shown == "back":
            times.append(self.back + self.hold)
        return min([*times, self.seen + self.forget])

    def _stale(self, t: int, start: int) -> bool:
        """The condition was dropped or replaced by one that ends at another time."""
        return start not in self.held or t not in (start, self.held[start][2])

    def _until(self, end: int) -> list[tuple]:
        told: list[tuple] = []
        while (t := self._next()) is not None and t <= end:
            self.now = t
            if t >= self.seen + self.forget:
                told.append((t, None, "gone", None))
                self.held, self.starts, self.times = {}, [], []
                self.now, self.full, self.seen, self.back, self.status, self.shown = _NEVER, _NEVER, _NEVER, _NEVER, None, "new"
                break
            told += self._evaluate(t)
        return told

    def _saved(self, key: tuple, told: list[tuple]) -> list[Row]:
        after = self._next()
        timer = _NEVER if after is None else -(-after // 1000)
        if timer != self.timer:
            if self.timer != _NEVER:
                self.handle.deleteTimer(self.timer)
            if timer != _NEVER:
                self.handle.registerTimer(timer)
        if after is None:
            self.clock.clear()
        else:
            held = json.dumps([(start, *h) for start, h in self.held.items()])
            self.clock.update((self.now, self.full, self.seen, self.back, self.status, self.shown, timer, held))
        return [Row(lift=key[0], at_us=at, status=status, shown=shown, since_us=since) for at, status, shown, since in told]


def live_status(conditions: DataFrame, keep: int | None = None, hold_minutes: int = 30, forget_minutes: int = 26 * 60, delay: str = "0 seconds") -> DataFrame:
    """STR-1, STR-2 on timers. conditions: a stream of (id, lift, status, start, end, received) and maybe full. Gives a row whenever
    what is shown of a lift changes: lift, at_us, status, shown (a status that isn't available, "back" for hold_minutes after one,
    null for available, "gone" after forget_minutes without a message), since_us (when it came back). A full state replaces what
    was received before it; lifts that it leaves out are silent and go by their timer. A start or end in the future takes effect
    by itself. Messages that come later than `delay` behind others take effect when they come. All conditions since the last full
    state count; with `keep` only the newest so many by start, as the reference's listener has it."""
    full = F.col("full") if "full" in conditions.columns else F.lit(False)
    x = conditions.withWatermark("received", delay)
    us = [F.unix_micros(c).alias(c) for c in ("start", "end", "received")]
    # one text a message: a row reaches the processor cell by cell, and a cell costs more than parsing the text
    message = F.to_json(F.struct(F.col("id").cast("bigint").alias("id"), "status", *us, F.coalesce(full, F.lit(False)).alias("full")))
    x = x.select(F.col("lift").cast("bigint").alias("lift"), message.alias("message"))
    return x.groupBy("lift").transformWithState(Facility(keep, hold_minutes, forget_minutes), STATUS, "Append", "EventTime")
