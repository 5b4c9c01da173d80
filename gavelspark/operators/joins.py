"""Joins of bids, auctions and persons.

In batch a hot join key is left to the adaptive skew join. Streams have none, so the
joins whose larger side is keyed by an auction or seller take ``salts``: the larger side
is dealt to that many parts per key and the other side is sent to each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators.project import LOCAL_CATEGORY, LOCAL_STATES, in_category, in_states

_SALT = "_salt"


def _dealt(df: DataFrame, salts: int) -> DataFrame:
    if salts == 1:
        return df.withColumn(_SALT, F.lit(0).cast("long"))
    return df.withColumn(_SALT, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))


def _copied(df: DataFrame, salts: int) -> DataFrame:
    if salts == 1:
        return df.withColumn(_SALT, F.lit(0).cast("long"))
    return df.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def keyed_join(
    many: DataFrame, one: DataFrame, on: Sequence[tuple[str, str]], where: Column | None = None, salts: int = 1
) -> DataFrame:
    """Inner join on pairs of columns; the column names of the two sides must differ."""
    if salts > 1:
        many, one = _dealt(many, salts), _copied(one, salts).withColumnRenamed(_SALT, "_salt_one")
        on = [*on, (_SALT, "_salt_one")]
    condition = None
    for left, right in on:
        pair = F.col(left) == F.col(right)
        condition = pair if condition is None else condition & pair
    if where is not None:
        condition = condition & where
    joined = many.join(one, condition)
    return joined.drop(_SALT, "_salt_one") if salts > 1 else joined


def local_items(
    auctions: DataFrame, persons: DataFrame, category: int | None = LOCAL_CATEGORY,
    states: Sequence[str] = LOCAL_STATES, max_gap: str | None = None, salts: int = 1,
) -> DataFrame:
    """Who sells an auction (of the category) and lives in one of the states.

    On two streams without ``max_gap`` both histories stay in state for good. With it an
    auction and a person meet only if their times (watermarked) are that close.
    """
    if category is not None:
        auctions = in_category(auctions, category)
    timed = ["ts"] if max_gap else []
    items = auctions.select("id", "seller", *[F.col(c).alias("opened") for c in timed])
    locals_ = in_states(persons, states).select(
        F.col("id").alias("person_id"), "name", "city", "state", *[F.col(c).alias("registered") for c in timed]
    )
    near = None
    if max_gap:
        gap = F.expr(f"interval {max_gap}")
        near = F.col("opened").between(F.col("registered") - gap, F.col("registered") + gap)
    joined = keyed_join(items, locals_, [("seller", "person_id")], near, salts)
    return joined.select("name", "city", "state", "id")


# Which bids count for an auction.
BEFORE_EXPIRY = "before expiry"
IN_LIFETIME = "in lifetime"
AT_OR_AFTER_EXPIRY = "at or after expiry"


def bid_auction_join(
    bids: DataFrame, auctions: DataFrame, keep: Sequence[str] = ("category",), rule: str = BEFORE_EXPIRY,
    max_lifetime: str | None = None, salts: int = 1,
) -> DataFrame:
    """Bids with the expiry and the ``keep`` columns of their auction.

    The bid's own columns stay. ``max_lifetime`` bounds the state on watermarked streams:
    a bid then meets an auction opened at most that long before it.
    """
    opened = [F.col("ts").alias("opened")] if rule == IN_LIFETIME or max_lifetime else []
    sides = auctions.select(F.col("id").alias("auction_id"), "expires", *opened, *keep)
    bid_time = F.col("ts")
    where = {
        BEFORE_EXPIRY: bid_time < F.col("expires"),
        AT_OR_AFTER_EXPIRY: bid_time >= F.col("expires"),
        IN_LIFETIME: bid_time.between(F.col("opened"), F.col("expires")) if opened else None,
    }[rule]
    if max_lifetime:
        where = where & bid_time.between(F.col("opened"), F.col("opened") + F.expr(f"interval {max_lifetime}"))
    joined = keyed_join(bids, sides, [("auction", "auction_id")], where, salts)
    return joined.drop("auction_id", "opened")


def rejected_bids(bids: DataFrame, auctions: DataFrame, keep: Sequence[str] = ("category",), salts: int = 1) -> DataFrame:
    """Bids at or after the end of their auction: what is left when it is over."""
    return bid_auction_join(bids, auctions, keep, AT_OR_AFTER_EXPIRY, salts=salts)


def new_sellers(persons: DataFrame, auctions: DataFrame, size: str = "10 seconds", salts: int = 1) -> DataFrame:
    """Persons who open an auction in the window in which they register.

    Both sides carry the window as ``window_start`` / ``window_end``. On streams the
    window structs are compared, so that state goes with the watermark.
    """
    windowed_persons = persons.select(
        F.col("id").alias("person_id"), "name", F.window("ts", size).alias("person_window")
    )
    windowed_auctions = auctions.select("seller", "reserve", F.window("ts", size).alias("window"))
    pairs = [("seller", "person_id"), ("window", "person_window")]
    joined = keyed_join(windowed_auctions, windowed_persons, pairs, salts=salts)
    return joined.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        F.col("person_id").alias("id"), "name", "reserve",
    )


def sellers_within(persons: DataFrame, auctions: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Persons and their auctions less than ``gap`` apart, in either order.

    Times are cut into bands of one gap: an auction meets the persons of its own band
    and the two next to it, not the seller's whole history.
    """
    size = F.lit(micros(gap))
    at = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    nearby = persons.select(F.col("id").alias("person_id"), "name", F.col("ts").alias("registered")).withColumn(
        "person_band",
        F.explode(F.array(*[F.floor(at("registered") / size).cast("long") + step for step in (-1, 0, 1)])),
    )
    opened = auctions.select("seller", "reserve", F.col("ts").alias("opened")).withColumn(
        "band", F.floor(at("opened") / size).cast("long")
    )
    close = F.abs(at("opened") - at("registered")) < size
    joined = keyed_join(opened, nearby, [("seller", "person_id"), ("band", "person_band")], close)
    return joined.select(F.col("person_id").alias("id"), "name", "reserve", "registered", "opened")


def at_group_max(rows: DataFrame, keys: Sequence[str], value: str, salts: int = 1) -> DataFrame:
    """The rows that hold the largest value of their group, ties included.

    The maximum is one small row per group. It joins back on group *and* value, so a
    group is never gathered in one place.
    """
    best = rows.groupBy(*keys).agg(F.max(value).alias("_best")).select(
        *[F.col(k).alias(f"_best_{k}") for k in keys], "_best"
    )
    pairs = [*[(k, f"_best_{k}") for k in keys], (value, "_best")]
    return keyed_join(rows, best, pairs, salts=salts).select(*rows.columns)
