"""Arguments of queries: limits, cursors and times, made safe before a plan is built."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta


def limit(value: float | None, default: int, most: int = 200) -> int:
    """A number of rows from 1 to `most`."""
    return int(min(max(default if value is None else value, 1), most))


def positive(value: float | None, default: int) -> int:
    """A positive whole number, else the default."""
    return math.floor(value) if value is not None and math.isfinite(value) and value > 0 else default


def cursor(value: str | None) -> int:
    """The offset that a page's cursor names, 0 if it names none."""
    digits = (value or "").strip()
    return int(digits) if digits.isdigit() else 0


def timestamp(value: str | None, name: str) -> str | None:
    """A time as ISO-8601 in UTC with milliseconds; an error that names the argument if it is none."""
    if not value:
        return None
    try:
        t = datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name} must be a valid ISO-8601 timestamp.") from None
    t = (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def days_before(now: str, days: int) -> str:
    """The time so many days before another."""
    return timestamp((datetime.fromisoformat(now) - timedelta(days=days)).isoformat(), "now")
