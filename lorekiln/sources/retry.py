"""Retrying a call to a store outside Spark, for writers used in ``foreachBatch``."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

Result = TypeVar("Result")
#: First wait, and the share of a wait that chance may add.
FIRST_WAIT_S, JITTER = 0.25, 0.25


def waits(attempts: int, chance: Callable[[], float] = random.random) -> list[float]:
    """The waits between attempts: each twice the one before, with some chance added."""
    return [FIRST_WAIT_S * 2**n * (1 + JITTER * chance()) for n in range(max(0, attempts - 1))]


def retry(call: Callable[[], Result], attempts: int = 4, retryable: tuple[type[BaseException], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep) -> Result:
    """The call's result; after the last attempt its error. Other errors are not retried."""
    for wait in [*waits(attempts), None]:
        try:
            return call()
        except retryable:
            if wait is None:
                raise
            sleep(wait)
    raise AssertionError("unreachable")
