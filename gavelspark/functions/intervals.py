"""Interval texts as microseconds."""

from __future__ import annotations

# Microseconds per unit.
UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def micros(interval: str) -> int:
    """``"90 seconds"`` or ``"1 hour 30 minutes"`` in microseconds."""
    words = interval.split()
    if not words or len(words) % 2:
        raise ValueError(f"not an interval: {interval!r}")
    total = 0
    for amount, unit in zip(words[::2], words[1::2]):
        unit = unit.lower().removesuffix("s")
        if unit not in UNIT_MICROS:
            raise ValueError(f"not an interval: {interval!r}")
        total += int(amount) * UNIT_MICROS[unit]
    return total
