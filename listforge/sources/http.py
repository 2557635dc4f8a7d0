"""HTTP with retries, for readers that fetch pages; runs inside partitions."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

RETRIED = {408, 425, 429}
TIMEOUT, ATTEMPTS, LONGEST, FIRST = 25.0, 3, 30.0, 0.5


def retryable(status: int) -> bool:
    return status in RETRIED or status >= 500


def backoff(attempt: int, rand: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: doubled each time, up to a quarter more by chance."""
    return min(LONGEST, FIRST * 2 ** (attempt - 1) * (1 + 0.25 * rand()))


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds a server asks to wait, given as such or as a date."""
    if not value:
        return None
    if value.strip().isdigit():
        return min(LONGEST, float(value))
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return min(LONGEST, max(0.0, (at - (now or datetime.now(UTC))).total_seconds()))


def concurrency(n: int | None) -> int:
    return max(1, min(8, n or 4))


def fetch(url: str, open_url=urllib.request.urlopen, sleep=time.sleep, attempts: int = ATTEMPTS, rand=random.random) -> str:
    """Text of a response; raises the last error after ``attempts``, at once where another try is no use."""
    for attempt in range(1, attempts + 1):
        try:
            with open_url(url, timeout=TIMEOUT) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if not retryable(e.code) or attempt == attempts:
                raise
            wait = retry_after(e.headers.get("Retry-After") if e.headers else None)
        except (urllib.error.URLError, TimeoutError):
            if attempt == attempts:
                raise
            wait = None
        sleep(wait if wait is not None else backoff(attempt, rand))
    raise RuntimeError("no attempt was made")
