"""Timers of a join's phases: partition, build, probe."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

PHASES = ("partition", "build", "probe")


class Stopwatch:
    """Adds up what it is started for."""

    def __init__(self) -> None:
        self.total, self._began = 0, None

    def start(self) -> None:
        if self._began is not None:
            raise RuntimeError("the stopwatch runs already")
        self._began = time.perf_counter_ns()

    def stop(self) -> int:
        if self._began is None:
            raise RuntimeError("the stopwatch doesn't run")
        self.total += time.perf_counter_ns() - self._began
        self._began = None
        return self.total


class PhaseTimer:
    """Durations of phases in nanoseconds: measured around a block, or set."""

    def __init__(self) -> None:
        self._watches = {p: Stopwatch() for p in PHASES}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        self._watches[name].start()
        try:
            yield
        finally:
            self._watches[name].stop()

    def set(self, name: str, nanoseconds: int) -> None:
        if nanoseconds < 0:
            raise ValueError("durations aren't negative")
        self._watches[name].total = nanoseconds

    def durations(self) -> dict[str, int]:
        return {p: w.total for p, w in self._watches.items()}


class NoTimer(PhaseTimer):
    """Measures nothing."""

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        yield

    def set(self, name: str, nanoseconds: int) -> None:
        pass
