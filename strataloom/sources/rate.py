"""A rate of requests, shared by the tasks of a job."""

from __future__ import annotations

import time
from collections.abc import Callable


class TokenBucket:
    """At most ``burst`` requests at once and ``rate`` a second after that.

    In any span of t seconds no more than ``burst + rate * t`` requests are let
    through.  Clock and sleep can be replaced; the clock never goes back.
    """

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if not rate > 0 or not burst >= 1:
            raise ValueError("rate must be above 0 and burst at least 1")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def _refill(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now

    def acquire(self) -> None:
        """Wait until one more request is allowed."""
        self._refill()
        while self.tokens < 1 - 1e-9:
            self.sleep((1 - self.tokens) / self.rate)
            self._refill()
        self.tokens -= 1


def shares(rate: float, burst: int, tasks: int) -> tuple[int, float, float]:
    """(tasks, rate of each, burst of each) so that together they stay within ``rate`` and ``burst``.

    A task's bucket holds at least one request, so there are at most ``burst``
    tasks; with fewer live at a time the rate is lower, never higher.
    """
    n = max(1, min(tasks, burst))
    return n, rate / n, burst / n
