"""Scalar expressions of the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def convert_price(price: Column | str, rate: float = 0.82) -> Column:
    """Single-precision product, cut towards zero. Both sides must be single precision."""
    return (F.lit(rate).cast("float") * _col(price).cast("float")).cast("long")


def ratio(total: Column | str, count: Column | str) -> Column:
    """Double division of two whole numbers."""
    return _col(total).cast("double") / _col(count)


def ratio_or_zero(total: Column | str, count: Column | str) -> Column:
    """As ``ratio``, and 0 where there is nothing to divide by."""
    count = _col(count)
    return F.when(count == 0, F.lit(0.0)).otherwise(ratio(total, count))


def later(a: Column | str, b: Column | str) -> Column:
    return F.greatest(_col(a), _col(b))


def split_longs(text: Column | str, separator: str = "_") -> Column:
    """``"5_10"`` as an array of whole numbers."""
    return F.transform(F.split(_col(text), separator), lambda part: part.cast("long"))


def pair_text(first: Column | str, second: Column | str) -> Column:
    return F.format_string("(%s,%s)", _col(first), _col(second))


def hot_item_text(auction: Column | str, count: Column | str, window_end: Column | str) -> Column:
    """The announcement of a window's hottest auction; the window end in epoch milliseconds."""
    end = F.unix_millis(_col(window_end).cast("timestamp"))
    # Fixed value: the wording of the announcement.
    return F.format_string(
        "Auction %s had the highest number of bids: %s in the window ending %s", _col(auction), _col(count), end
    )


def clock_time(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def log_time(line: Column | str) -> Column:
    """The time a log line starts with, to the millisecond; null where it has none."""
    # Fixed value: the time format of the logs.
    return F.try_to_timestamp(F.substring(_col(line), 1, 23), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole difference in microseconds, not only of the fractions."""
    return F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Difference of the full seconds."""
    return F.unix_seconds(_col(end).cast("timestamp")) - F.unix_seconds(_col(start).cast("timestamp"))
