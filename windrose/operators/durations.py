"""Window lengths: literals to milliseconds, and their rules."""

from __future__ import annotations

UNITS = {"MILLISECONDS": 1, "SECONDS": 1000, "MINUTES": 60_000}
_SPANS = {"milliseconds": 1, "millisecond": 1, "ms": 1, "seconds": 1000, "second": 1000, "s": 1000, "minutes": 60_000, "minute": 60_000, "hours": 3_600_000, "hour": 3_600_000, "days": 86_400_000, "day": 86_400_000}


class WindowError(ValueError):
    """A window clause that can't be run."""


def literal(number: str, unit: str) -> int:
    """Milliseconds of a number, bare or quoted, and a plural unit."""
    n = number.strip("'\"").strip()
    if not n.isdigit() or unit.upper() not in UNITS:
        raise WindowError(f"not a duration: {number} {unit}; wanted is a whole number of {', '.join(UNITS)}")
    return int(n) * UNITS[unit.upper()]


def span(text: str | int) -> int:
    """Milliseconds of '1 second', '500 ms' or a number of milliseconds."""
    if isinstance(text, int):
        return text
    number, _, unit = text.strip().partition(" ")
    if not number.isdigit() or unit.strip().lower() not in _SPANS:
        raise WindowError(f"not a duration: {text!r}")
    return int(number) * _SPANS[unit.strip().lower()]


def spelled(ms: int) -> str:
    return f"{ms} milliseconds"


def check(width: int, slide: int, batch: int | None) -> None:
    """Both must be positive and, where the batch interval is set, multiples of it."""
    if width <= 0 or slide <= 0:
        raise WindowError("a window and its slide must be longer than 0")
    if batch and (width % batch or slide % batch):
        raise WindowError(f"window {width} ms and slide {slide} ms must be multiples of the batch interval, {batch} ms")
