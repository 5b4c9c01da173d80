"""Event-time windows, watermarks and the rules for windows that are over."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators.scan import OrderBy, running_before

WINDOW_COLUMNS = ["window_start", "window_end"]


def flat_window(df: DataFrame) -> DataFrame:
    """Replace the ``window`` struct by its two ends."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def windowed(
    df: DataFrame, aggs: Sequence[Column], size: str, slide: str | None = None,
    keys: Sequence[str] = (), ts: str = "ts",
) -> DataFrame:
    """Aggregate by event-time window and keys. Windows are aligned to the epoch, end exclusive."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return flat_window(df.groupBy(window, *keys).agg(*aggs))


def sliding_counts(
    df: DataFrame, keys: Sequence[str], size: str, slide: str, ts: str = "ts", name: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per sliding window and key, by way of panes. ``weight`` counts a row as several.

    Assigning rows to windows multiplies them by size/slide. Here rows are counted per
    pane of one slide first. A pane feeds windows that start within one ``size`` before
    it, that is in at most two size-long stretches: it is sent to both, and only there
    fanned out to windows, which need no second exchange.
    """
    one = F.count("*") if weight is None else F.sum(weight)
    size_us, slide_us = micros(size), micros(slide)
    if df.isStreaming and size_us % slide_us:
        return windowed(df, [one.alias(name)], size, slide, keys, ts)
    if df.isStreaming:
        panes = df.groupBy(F.window(ts, slide).alias("pane"), *keys).agg(one.alias("_n"))
        return flat_window(panes.groupBy(F.window("pane", size, slide), *keys).agg(F.sum("_n").alias(name)))

    kind = df.schema[ts].dataType.simpleString()
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # a pane lies within the same windows as a whole: its width divides size and slide
    pane_us = gcd(size_us, slide_us)
    panes = df.groupBy(*keys, (at - F.pmod(at, F.lit(pane_us))).alias("_pane")).agg(one.alias("_n"))
    newest = F.col("_pane") - F.pmod(F.col("_pane"), F.lit(slide_us))
    late = F.col("_pane") - size_us + pane_us
    # the first window start from there on
    oldest = late + F.pmod(-late, F.lit(slide_us))

    # a stretch begins with a window start, whether or not the slide divides the size
    long_us = -(-size_us // slide_us) * slide_us

    def stretch(c: Column) -> Column:
        return c - F.pmod(c, F.lit(long_us))

    placed = panes.filter(oldest <= newest).withColumn(
        "_stretch", F.explode(F.array_distinct(F.array(stretch(oldest), stretch(newest))))
    ).repartition(*keys, "_stretch")
    starts = F.sequence(
        F.greatest(F.col("_stretch"), oldest),
        F.least(F.col("_stretch") + (long_us - slide_us), newest),
        F.lit(slide_us),
    )
    counted = (
        placed.withColumn("_start", F.explode(starts))
        .groupBy(*keys, "_stretch", "_start")
        .agg(F.sum("_n").alias(name))
    )
    return counted.select(
        F.timestamp_micros("_start").cast(kind).alias("window_start"),
        F.timestamp_micros(F.col("_start") + size_us).cast(kind).alias("window_end"),
        *keys,
        name,
    )


def with_watermark(df: DataFrame, delay: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Event time with a bound on lateness; zone-free times become instants first."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def closed_windows(result: DataFrame, events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """The windows of a batch result that a stream with this delay would have emitted."""
    watermark = events.agg(F.max(ts) - F.expr(f"interval {delay}"))
    return result.filter(F.col("window_end") <= watermark.scalar())


def late_flags(
    df: DataFrame, arrival: OrderBy, size: str, delay: str, ts: str = "ts"
) -> DataFrame:
    """Mark rows whose window was over when they arrived.

    The watermark a row meets is the latest event time among earlier arrivals, less the
    delay. There is no key: the arrivals are scanned in chunks.
    """
    seen = running_before(df, [], arrival, {"_latest": ("max", ts)})
    end = F.window(ts, size)["end"]
    watermark = F.col("_latest") - F.expr(f"interval {delay}")
    flagged = seen.withColumn("_end", end).withColumn(
        "is_late", F.coalesce(F.col("_end") <= watermark, F.lit(False))
    )
    return flagged.drop("_latest", "_end")
