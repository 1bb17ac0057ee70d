"""Folds of live sessions that wait: liveness, grace, throttles, bounded previews, and a watchdog of decoders.

Each is a keyed.Fold, to be run over a batch or a stream. Columns of the rows are named in the docstrings,
beside at_ms; what a fold gives is named beside it. Times are milliseconds; the defaults are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from parlance.streaming.keyed import Fold

LIVENESS = "session int, started_ms long, ended_ms long, messages long"


class Liveness(Fold):
    """A session ends when nothing has come for ``limit``; what comes later begins the next one."""

    limit = 50_000

    def add(self, row: Any) -> Iterator[tuple]:
        self.state = {"n": self.state.get("n", 0), "first": self.state.get("first", row.at_ms), "last": row.at_ms, "messages": self.state.get("messages", 0) + 1}
        yield from ()

    def due(self) -> int | None:
        return self.state["last"] + self.limit if "last" in self.state else None

    def wake(self, at_ms: int) -> Iterator[tuple]:
        yield self.state["n"], self.state["first"], at_ms, self.state["messages"]
        self.state = {"n": self.state["n"] + 1}


HEALTH = "session int, at_ms long, frames long, samples long, peak double"


class Health(Liveness):
    """While a session lives it tells every ``interval`` what has come since its beginning: rows have samples and peak."""

    interval = 5_000

    def add(self, row: Any) -> Iterator[tuple]:
        before = self.state
        yield from super().add(row)
        self.state |= {"told": before.get("told", row.at_ms), "samples": before.get("samples", 0) + int(row.samples), "peak": max(before.get("peak", 0.0), float(row.peak))}

    def due(self) -> int | None:
        end = super().due()
        return None if end is None else min(end, self.state["told"] + self.interval)

    def wake(self, at_ms: int) -> Iterator[tuple]:
        if at_ms == self.state["last"] + self.limit:
            for _ in super().wake(at_ms):
                pass
        else:
            self.state["told"] = at_ms
            yield self.state["n"], at_ms, self.state["messages"], self.state["samples"], self.state["peak"]


GRACE = "absent_ms long, stop_ms long"


class Grace(Fold):
    """A capture stops when its own user, once seen, has been away for ``limit``: rows have present. Coming back in time cancels it."""

    limit = 3_500

    def add(self, row: Any) -> Iterator[tuple]:
        if row.present:
            self.state = {"seen": True}
        elif self.state.get("seen") and "absent" not in self.state:
            self.state["absent"] = row.at_ms
        yield from ()

    def due(self) -> int | None:
        return self.state["absent"] + self.limit if "absent" in self.state else None

    def wake(self, at_ms: int) -> Iterator[tuple]:
        yield self.state["absent"], at_ms
        self.state = {}


THROTTLE = "row_id long, scan_ms long, scanned boolean"


class Throttle(Fold):
    """A row reads anew if the last reading is ``interval`` old, and else is answered from that reading: rows have row_id."""

    interval = 250

    def add(self, row: Any) -> Iterator[tuple]:
        anew = "last" not in self.state or row.at_ms - self.state["last"] >= self.interval
        if anew:
            self.state["last"] = row.at_ms
        yield int(row.row_id), self.state["last"], anew


PREVIEWS = "row_id long, outcome string, in_flight int"


class Previews(Fold):
    """Which previews are worked on: rows have row_id, segment, is_final and work_ms (how long the work takes).

    A preview is refused if its segment is final, is already being worked on, or ``most`` previews are.
    Finals are never refused; they close their segment, and work on its preview goes on.
    """

    most = 4

    def _flight(self) -> dict[str, int]:
        return self.state.setdefault("flight", {})

    def add(self, row: Any) -> Iterator[tuple]:
        segment, flight = str(row.segment), self._flight()
        closed = self.state.setdefault("closed", [])
        if row.is_final:
            if segment not in closed:
                closed.append(segment)
            outcome = "final"
        elif segment in closed:
            outcome = "closed"
        elif segment in flight:
            outcome = "same"
        elif len(flight) >= self.most:
            outcome = "full"
        else:
            flight[segment] = row.at_ms + int(row.work_ms)
            outcome = "preview"
        yield int(row.row_id), outcome, len(flight)

    def due(self) -> int | None:
        return min(self._flight().values(), default=None)

    def wake(self, at_ms: int) -> Iterator[tuple]:
        self.state["flight"] = {s: end for s, end in self._flight().items() if end > at_ms}
        yield from ()


WATCHDOG = "at_ms long, person long, outcome string, attempt int"


class Watchdog(Fold):
    """Asks for a recovery where a person speaks and no audio comes for ``limit``: rows have person and kind (speaking, audio, left).

    Speaking arms a new generation, so an older one no longer counts when its time is over. Audio and
    leaving disarm and forget the person's attempts. One recovery runs at a time, for ``recovery``; after
    one is begun there is none for ``cooldown``; a person gets ``most``.
    """

    limit, recovery, cooldown, most = 6_000, 5_000, 30_000, 3

    def _armed(self) -> dict[str, int]:
        return self.state.setdefault("armed", {})

    def add(self, row: Any) -> Iterator[tuple]:
        person = str(int(row.person))
        if row.kind == "speaking":
            self._armed()[person] = row.at_ms
        elif row.kind in ("audio", "left"):
            self._armed().pop(person, None)
            self.state.setdefault("attempts", {}).pop(person, None)
        yield from ()

    def due(self) -> int | None:
        first = min(self._armed().values(), default=None)
        return None if first is None else first + self.limit

    def wake(self, at_ms: int) -> Iterator[tuple]:
        over = sorted((p for p, at in self._armed().items() if at + self.limit <= at_ms), key=int)
        for person in over:
            del self._armed()[person]
            attempts = self.state.setdefault("attempts", {})
            if at_ms < self.state.get("cool", at_ms) or at_ms < self.state.get("busy", at_ms):
                yield at_ms, int(person), "recovering", attempts.get(person, 0)
                continue
            attempts[person] = attempts.get(person, 0) + 1
            if attempts[person] > self.most:
                yield at_ms, int(person), "exhausted", attempts[person]
                continue
            self.state |= {"cool": at_ms + self.cooldown, "busy": at_ms + self.recovery}
            yield at_ms, int(person), "queued", attempts[person]


SPEECH = "person long, started_ms long, ended_ms long, ticks long"


class Session(Fold):
    """One of many sessions: a clock of its own, and what its speakers have open: rows have kind and person.

    ``tick`` moves the session's clock, ``on`` and ``off`` begin and end a person's speech, ``end`` closes all
    that is open, lowest person first, and the clock starts again. ``ticks`` is how far the clock moved.
    """

    def add(self, row: Any) -> Iterator[tuple]:
        kind, clock, speaking = row.kind, self.state.setdefault("clock", 0), self.state.setdefault("speaking", {})
        person = None if row.person is None or row.person != row.person else str(int(row.person))
        if kind == "tick":
            self.state["clock"] = clock + 1
        elif kind == "on" and person is not None and person not in speaking:
            speaking[person] = [row.at_ms, clock]
        elif kind == "off" and person in speaking:
            begun, at = speaking.pop(person)
            yield int(person), begun, row.at_ms, clock - at
        elif kind == "end":
            for p in sorted(speaking, key=int):
                begun, at = speaking[p]
                yield int(p), begun, row.at_ms, clock - at
            self.state = {}
