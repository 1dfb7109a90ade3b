"""The pairing rule for the two observations of one turn.

Pairing is greedy in arrival order, so it needs a small sequential state: the
turns still waiting for a counterpart and the ones that gave up recently.  This
is that state for one group of arrivals; Spark decides which arrivals form a
group (:mod:`turnlake.operators.correlate`, :mod:`turnlake.streaming.pairing`).
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

# Fixed values of the pairing rule.
TOKEN_SLACK = 50
TOKEN_FRACTION = 0.05
WINDOW_MS = 15_000
HOLD_MS = 20_000
MEMORY_MS = 60_000


class Seen(NamedTuple):
    """One observation; ``place`` is its position in arrival order."""

    place: tuple
    key: str
    source: str
    model: str | None
    tin: int
    tout: int
    cache: int
    ts: int
    flush: int


class Fate(NamedTuple):
    seen: Seen
    fate: str  # pair | single | suppressed
    partner: Seen | None
    at: int


def close(a: int, b: int) -> bool:
    return abs(a - b) <= max(TOKEN_SLACK, math.ceil(TOKEN_FRACTION * max(a, b)))


def tokens_agree(a: Seen, b: Seen) -> bool:
    """Outputs are close, and inputs are close as reported or with cache added."""
    return close(a.tout, b.tout) and (close(a.tin, b.tin) or close(a.tin + a.cache, b.tin + b.cache))


def models_equal(a: Seen, b: Seen) -> bool:
    return a.model is not None and a.model == b.model


class _Pool:
    """Observations of one source by token counts, so that copies in a burst are one entry to compare.

    Observations of the same counts (a *shape*) stay in the order ``rank``.
    """

    def __init__(self, rank: Callable[[Seen], tuple]) -> None:
        self.rank = rank
        self.by_time: list[tuple] = []
        self.shapes: list[tuple] = []
        self.alike: dict[tuple, list[tuple]] = {}

    @staticmethod
    def shape(s: Seen) -> tuple:
        return s.tout, s.tin, s.cache

    def add(self, s: Seen) -> None:
        insort(self.by_time, (s.ts, s.place, s))
        shape = self.shape(s)
        if shape not in self.alike:
            insort(self.shapes, shape)
            self.alike[shape] = []
        insort(self.alike[shape], (*self.rank(s), s))

    def drop(self, s: Seen) -> None:
        del self.by_time[bisect_left(self.by_time, (s.ts, s.place))]
        shape = self.shape(s)
        same = self.alike[shape]
        del same[bisect_left(same, self.rank(s))]
        if not same:
            del self.alike[shape]
            del self.shapes[bisect_left(self.shapes, shape)]

    def agreeing(self, s: Seen) -> Iterator[list[tuple]]:
        """The observations of every shape whose tokens agree with those of ``s``."""
        low = s.tout - max(TOKEN_SLACK, math.ceil(TOKEN_FRACTION * s.tout))
        high = max(s.tout + TOKEN_SLACK, int((s.tout + 1) / (1 - TOKEN_FRACTION)) + 1)
        for shape in self.shapes[bisect_left(self.shapes, (low,)) : bisect_left(self.shapes, (high + 1,))]:
            same = self.alike[shape]
            if tokens_agree(same[0][-1], s):
                yield same


class _Waiting(_Pool):
    """Those that wait for a counterpart; shapes are ordered by time."""

    def __init__(self) -> None:
        super().__init__(lambda s: (s.ts, s.place))

    def counterpart(self, s: Seen) -> Seen | None:
        """The nearest by tokens, then time, then arrival; else the only one in the window, if its model is equal."""
        best = None
        for same in self.agreeing(s):
            at = bisect_left(same, (s.ts,))
            near = [same[at][-1]] if at < len(same) else []
            if at:  # of those before, the nearest time's first arrival
                near.append(same[bisect_left(same, (same[at - 1][0],))][-1])
            for c in near:
                if abs(c.ts - s.ts) <= WINDOW_MS:
                    rank = (abs(c.tout - s.tout) + abs(c.tin - s.tin), abs(c.ts - s.ts), c.place)
                    if best is None or rank < best[0]:
                        best = rank, c
        if best is not None:
            return best[1]
        a, b = bisect_left(self.by_time, (s.ts - WINDOW_MS,)), bisect_left(self.by_time, (s.ts + WINDOW_MS + 1,))
        if b - a == 1 and models_equal(self.by_time[a][2], s):
            return self.by_time[a][2]
        return None


class _Remembered(_Pool):
    """Those that gave up; shapes and models are ordered by when."""

    def __init__(self) -> None:
        super().__init__(lambda s: (s.flush, s.place))
        self.by_model: dict[str, list[tuple]] = {}

    def add(self, s: Seen) -> None:
        super().add(s)
        if s.model is not None:
            insort(self.by_model.setdefault(s.model, []), (s.flush, s.place, s))

    def drop(self, s: Seen) -> None:
        super().drop(s)
        if s.model is not None:
            same = self.by_model[s.model]
            del same[bisect_left(same, (s.flush, s.place))]
            if not same:
                del self.by_model[s.model]

    def counterpart(self, s: Seen) -> Seen | None:
        """The first that gave up, in the window, of equal model or agreeing tokens."""
        best = None
        for same in chain([self.by_model.get(s.model, [])] if s.model is not None else [], self.agreeing(s)):
            for flush, place, c in same:
                if best is not None and best[:2] <= (flush, place):
                    break
                if abs(c.ts - s.ts) <= WINDOW_MS:
                    best = (flush, place, c)
                    break
        return best and best[2]


class PairingState:
    """Waiting and remembered observations of one group.

    Holds what arrived within the hold and memory times before now, nothing
    that has been decided earlier.
    """

    def __init__(self, tick_ms: int = 1000) -> None:
        self.tick_ms = tick_ms
        self.waiting = {"otel": _Waiting(), "jsonl": _Waiting()}
        self.memory = {"otel": _Remembered(), "jsonl": _Remembered()}
        self._due: list[tuple] = []
        self._fading: list[tuple] = []
        self._paired: set[tuple] = set()
        self._used: set[tuple] = set()

    def wait(self, s: Seen) -> None:
        self.waiting[s.source].add(s)
        heapq.heappush(self._due, (s.flush, s.place, s))

    def remember(self, s: Seen) -> None:
        self.memory[s.source].add(s)
        gone = -(-(s.flush + MEMORY_MS) // self.tick_ms) * self.tick_ms
        heapq.heappush(self._fading, (gone, s.place, s))

    def advance(self, now: int) -> list[Fate]:
        """Give up on what has waited long enough and forget what is old."""
        out = []
        while self._due and self._due[0][0] <= now:
            _, place, s = heapq.heappop(self._due)
            if place in self._paired:
                self._paired.discard(place)
                continue
            self.waiting[s.source].drop(s)
            self.remember(s)
            out.append(Fate(s, "single", None, s.flush))
        while self._fading and self._fading[0][0] <= now:
            _, place, s = heapq.heappop(self._fading)
            if place in self._used:
                self._used.discard(place)
                continue
            self.memory[s.source].drop(s)
        return out

    def arrive(self, s: Seen, now: int) -> list[Fate]:
        """Take one arrival; call :meth:`advance` for ``now`` first."""
        other = "jsonl" if s.source == "otel" else "otel"
        mate = self.waiting[other].counterpart(s)
        if mate is not None:
            self.waiting[other].drop(mate)
            self._paired.add(mate.place)
            return [Fate(s, "pair", mate, now), Fate(mate, "pair", s, now)]
        late = self.memory[other].counterpart(s)
        if late is not None:
            self.memory[other].drop(late)
            self._used.add(late.place)
            return [Fate(s, "suppressed", late, now)]
        self.wait(s)
        return []

    def give_up(self, now: int) -> list[Fate]:
        """Stop waiting for everything at once; it stays remembered."""
        out = []
        for s in self.still_waiting():
            self.waiting[s.source].drop(s)
            self._paired.add(s.place)
            self.remember(s._replace(flush=now))
            out.append(Fate(s, "single", None, now))
        return out

    def still_waiting(self) -> list[Seen]:
        return sorted(e[2] for side in self.waiting.values() for e in side.by_time)

    def still_remembered(self) -> list[Seen]:
        return sorted(e[2] for side in self.memory.values() for e in side.by_time)
