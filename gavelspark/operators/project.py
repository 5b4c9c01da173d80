"""Projections and filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.scalar import convert_price, hot_item_text, pair_text

# The states and the category of the local-items query.
LOCAL_STATES = ("OR", "ID", "CA")
LOCAL_CATEGORY = 10


def currency_conversion(bids: DataFrame, rate: float = 0.82) -> DataFrame:
    """Bids with the price in another currency."""
    return bids.select("auction", convert_price("price", rate).alias("price"), "bidder", "ts")


def in_states(persons: DataFrame, states: Sequence[str] = LOCAL_STATES) -> DataFrame:
    """Persons of the given states; a person without a state is in none."""
    return persons.filter(F.col("state").isin(*states))


def in_category(auctions: DataFrame, category: int = LOCAL_CATEGORY) -> DataFrame:
    return auctions.filter(F.col("category") == category)


def _moment(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def closed_auctions(auctions: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Auctions over before the given moment."""
    return auctions.filter(F.col("expires") < _moment(as_of))


def live_auctions(auctions: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Auctions that still run after the given moment."""
    return auctions.filter(F.col("expires") > _moment(as_of))


def hot_item_messages(hot: DataFrame) -> DataFrame:
    """Hot items (auction, n, window_end) as sentences."""
    return hot.select(hot_item_text("auction", "n", "window_end").alias("message"))


def tuple_messages(counts: DataFrame, first: str = "auction", second: str = "n") -> DataFrame:
    """Two columns as the text of one record, ready for a broker or text sink."""
    return counts.select(pair_text(first, second).alias("value"))
