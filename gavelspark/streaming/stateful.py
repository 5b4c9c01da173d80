"""Stream operators with timers, on keyed state. They need the RocksDB state store (``session.tune``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators.scan import present
from gavelspark.streaming import processors


# Keys are dealt to so many parts, each a table of keyed state: a call of the state for each key would take most of the time.
KEY_PARTS = 512


def key_part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_PARTS))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _offers(bids: DataFrame, auctions: DataFrame, keep: str) -> DataFrame:
    """Bids and auctions as one input; ``ts`` is kept for the watermark."""
    none = F.lit(0).cast("long")
    b = present(bids, "auction", "price", "bidder", "ts").select(
        F.col("auction").alias("key"), "seq", F.lit(False).alias("is_auction"), "price", "bidder",
        _micros("ts").alias("ts_us"), none.alias("expires_us"), none.alias("kept"), F.col("ts"),
    )
    a = present(auctions, "id", "expires", keep, "ts").select(
        F.col("id").alias("key"), "seq", F.lit(True).alias("is_auction"), none.alias("price"), none.alias("bidder"),
        none.alias("ts_us"), _micros("expires").alias("expires_us"), F.col(keep).alias("kept"), F.col("ts"),
    )
    return b.unionByName(a)


def expiry_timer_stream(bids: DataFrame, auctions: DataFrame, delay: str, keep: str = "category", hold: str = "1 day") -> DataFrame:
    """Bids with ``accepted``: before their auction's end, or left over when it passed.

    State goes ``hold`` after the watermark has passed the auction's end, or the last bid of an
    auction that never came. Rows without a key, price or time take no part.
    """
    both = _offers(bids, auctions, keep).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    joined = both.withColumn("part", key_part("key")).groupBy("part").transformWithStateInPandas(
        processors.ExpiryTimer(micros(hold) // processors.MILLI),
        "auction long, price long, bidder long, ts_us long, expires_us long, kept long, accepted boolean",
        "Append", "EventTime",
    )
    named = joined.withColumn("expires", F.timestamp_micros("expires_us")).withColumnRenamed("kept", keep).drop("expires_us")
    return named.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
