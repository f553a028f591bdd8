"""Retries with growing waits."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

Result = TypeVar("Result")


def waits(attempts: int = 3, delay_ms: float = 1000, backoff: float = 1.5) -> list[int]:
    """Milliseconds to wait after each failed attempt but the last; halves are rounded up."""
    return [math.floor(delay_ms * backoff**i + 0.5) for i in range(max(attempts, 1) - 1)]


def wait_ms(attempt: Column, delay_ms: float = 1000, backoff: float = 1.5) -> Column:
    """The same as an expression: the wait after attempt 0, 1, ..."""
    return F.floor(F.lit(float(delay_ms)) * F.pow(F.lit(float(backoff)), attempt) + 0.5).cast("long")


def retry(call: Callable[[], Result], attempts: int = 3, delay_ms: float = 1000, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep, on_retry: Callable[[], None] | None = None) -> Result:
    """``call()``, again after each failure, as often as asked; the last failure is raised. ``on_retry`` is told of each further attempt."""
    pauses = waits(attempts, delay_ms, backoff)
    for i in range(max(attempts, 1)):
        try:
            return call()
        except Exception:
            if i == len(pauses):
                raise
            if on_retry is not None:
                on_retry()
            sleep(pauses[i] / 1000)
    raise AssertionError
