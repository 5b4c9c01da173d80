"""Aggregations over bids and closed auctions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gavelspark.functions.scalar import ratio, ratio_or_zero
from gavelspark.operators.joins import BEFORE_EXPIRY, IN_LIFETIME, at_group_max, bid_auction_join
from gavelspark.operators.project import closed_auctions
from gavelspark.operators.scan import (
    ALL_HOT, COPY_BLOCK, HOT_ROWS, OrderBy, order_names, present, repeat_rows, running_before, split_keys,
)
from gavelspark.operators.windows import WINDOW_COLUMNS, sliding_counts, windowed

# Order of joined bids: event time, then price, then the parties. Total up to copies.
# The widths bound a task by an hour of distinct instants or by a million of prices.
BID_ORDER: OrderBy = (("ts", "1 hour"), ("price", 1 << 20), "auction", "bidder")


def bid_counts(bids: DataFrame, size: str = "60 minutes", slide: str = "1 minute") -> DataFrame:
    """Bids per auction in each sliding window."""
    return sliding_counts(bids, ["auction"], size, slide)


def hot_items(bids: DataFrame, size: str = "60 minutes", slide: str = "1 minute") -> DataFrame:
    """The auctions with the most bids in each sliding window, ties included."""
    return at_group_max(bid_counts(bids, size, slide), WINDOW_COLUMNS, "n")


def highest_bid_per_auction(
    bids: DataFrame, size: str = "10 minutes", tie_order: Sequence[str] = ("ts", "bidder")
) -> DataFrame:
    """Per window and auction the highest bid; of equal ones the last in ``tie_order``."""
    fields = dict.fromkeys(["price", *tie_order, "bidder"])
    top = F.max(F.struct(*fields)).alias("top")
    best = windowed(bids, [top], size, keys=["auction"])
    return best.select(
        *WINDOW_COLUMNS, "auction", F.col("top.price").alias("price"), F.col("top.bidder").alias("bidder")
    )


def highest_bids(bids: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Per window all bids at the window's highest price."""
    placed = bids.select(F.window("ts", size).alias("window"), "auction", "price", "bidder").select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "auction", "price", "bidder",
    )
    return at_group_max(placed, WINDOW_COLUMNS, "price")


def max_price_bid(bids: DataFrame, keys: Sequence[str] = ("auction",), tie_order: Sequence[str] = ("bidder",)) -> DataFrame:
    """The highest bid of each group over the whole input; the last in ``tie_order`` wins."""
    top = bids.groupBy(*keys).agg(F.max(F.struct("price", *tie_order)).alias("top"))
    return top.select(*keys, F.col("top.price").alias("price"), *[F.col(f"top.{c}").alias(c) for c in tie_order])


def final_prices(
    bids: DataFrame, auctions: DataFrame, keep: Sequence[str] = ("category",), rule: str = BEFORE_EXPIRY
) -> DataFrame:
    """Highest valid bid per auction."""
    valid = bid_auction_join(bids, auctions, keep, rule)
    return valid.groupBy("auction", "expires", *keep).agg(F.max("price").alias("final"))


def avg_price_by_category(bids: DataFrame, auctions: DataFrame, rule: str = IN_LIFETIME) -> DataFrame:
    """Average over its auctions of the highest valid bid, per category."""
    return average_price(final_prices(bids, auctions, ["category"], rule), "category")


def average_price(finals: DataFrame, key: str) -> DataFrame:
    return finals.groupBy(key).agg(
        F.count("*").alias("auctions"), ratio(F.sum("final"), F.count("*")).alias("avg_price")
    )


SALES_BLOCK = 1 << 16


def avg_of_last_sales(
    bids: DataFrame, auctions: DataFrame, as_of: datetime | str | Column, last: int = 10
) -> DataFrame:
    """Per closed auction, the average final price of its seller's last ``last`` ones so far."""
    finals = final_prices(bids, closed_auctions(auctions, as_of), ["seller"])
    return moving_average(finals, "seller", (("expires", "1 day"), ("auction", 1 << 20)), "final", last)


def moving_average(
    rows: DataFrame, key: str, order_by: OrderBy, value: str, last: int, block: int = SALES_BLOCK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """Average over the last ``last`` rows of the key, for every row that has a value."""
    # counted by the value: all uses of the rows then need all their columns and share one exchange
    one = F.when(F.col(value).isNotNull(), F.lit(1))
    rows = present(rows, key, value)
    if hot_rows is ALL_HOT:
        return _moving_average_of_hot(rows, key, order_by, value, last, block, one)
    cold, hot = split_keys(rows, [key], hot_rows, one)
    frame = Window.partitionBy(key).orderBy(*order_names(order_by)).rowsBetween(-(last - 1), 0)
    return _averaged(cold, frame, value).unionByName(
        _moving_average_of_hot(hot, key, order_by, value, last, block, one)
    )


def _averaged(rows: DataFrame, frame: WindowSpec, value: str) -> DataFrame:
    sales = F.count("*").over(frame)
    return rows.withColumns({"sales": sales, f"avg_{value}": ratio(F.sum(value).over(frame), sales)})


def _moving_average_of_hot(
    rows: DataFrame, key: str, order_by: OrderBy, value: str, last: int, block: int, one: Column
) -> DataFrame:
    """Rows are numbered by a chunked scan and cut into blocks.

    Each block also gets the ``last - 1`` rows before it, from as many blocks as these take,
    so that the frames run block by block.
    """
    columns = rows.columns
    numbered = running_before(rows, [key], order_by, {"_n": ("sum", one)}, ALL_HOT).withColumn(
        "_n", F.coalesce("_n", F.lit(0))
    )
    own = F.floor(F.col("_n") / block)
    # a row also leads in every later block that a frame with it reaches
    leads = F.sequence(own, F.floor((F.col("_n") + (last - 1)) / block))
    placed = numbered.withColumn("_block", F.explode(leads))
    frame = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(-(last - 1), 0)
    return _averaged(placed, frame, value).filter(F.col("_block") == own).select(*columns, "sales", f"avg_{value}")


def record_highs(
    rows: DataFrame, key: str, position: str = "ts", chunk: int | str = "1 hour",
    tie_order: Sequence[str] = ("auction", "bidder"), hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """The rows whose price is above every earlier price of their key.

    Earlier means a smaller ``position``, then a smaller price, then ``tie_order``. With
    ``hot_rows`` ``ALL_HOT`` no key goes through the plain window.
    """
    rows = present(rows, key, position, "price")
    if hot_rows is ALL_HOT:
        return _record_highs_of_hot(rows, key, position, chunk, tie_order)
    cold, hot = split_keys(rows, [key], hot_rows)
    earlier = (
        Window.partitionBy(key).orderBy(position, "price", *tie_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    best = F.max("price").over(earlier)
    records = cold.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("price") > F.col("_best")))
    return records.select(key, position, "price", *tie_order).unionByName(
        _record_highs_of_hot(hot, key, position, chunk, tie_order)
    )


def _record_highs_of_hot(
    rows: DataFrame, key: str, position: str, chunk: int | str, tie_order: Sequence[str]
) -> DataFrame:
    """Within one position every price above the past is a record, held by its first row.

    So rows are collapsed to (position, price) before anything is ordered. The peak of a
    position carries its first row along, only so that both uses of the collapsed rows
    read the same exchange and the input is computed once.
    """
    firsts = rows.groupBy(key, position, "price").agg(F.min(F.struct(*tie_order)).alias("_first"))
    peaks = firsts.groupBy(key, position).agg(F.max(F.struct("price", "_first")).alias("_peak"))
    past = running_before(peaks, [key], [(position, chunk)], {"_best": ("max", "_peak")}, hot_rows=ALL_HOT).select(
        F.struct(key, position).alias("_at"), F.col("_best.price").alias("_best")
    )
    # one struct as the join key: from single columns Spark derives filters for one use of ``firsts`` only
    above = F.col("_best").isNull() | (F.col("price") > F.col("_best"))
    records = firsts.join(past, (F.struct(key, position) == F.col("_at")) & above)
    return records.select(key, position, "price", *[F.col(f"_first.{c}").alias(c) for c in tie_order])


def running_average(
    rows: DataFrame, key: str, order_by: OrderBy = BID_ORDER, value: str = "price", block: int = COPY_BLOCK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """After every row of a key that has a value, the count and average of the values so far."""
    names = order_names(order_by)
    if value not in names:
        names, order_by = [*names, value], [*order_by, value]
    rows = present(rows, key, value)
    if hot_rows is ALL_HOT:
        return _running_average_of_hot(rows, key, order_by, value, block)
    cold, hot = split_keys(rows, [key], hot_rows)
    so_far = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.count("*").over(so_far), F.sum(value).over(so_far)
    averaged = cold.select(key, *names, n.alias("running_count"), ratio(total, n).alias("running_avg"))
    return averaged.unionByName(_running_average_of_hot(hot, key, order_by, value, block))


def _running_average_of_hot(rows: DataFrame, key: str, order_by: OrderBy, value: str, block: int) -> DataFrame:
    """Copies (rows equal in key and order) are counted first and numbered last."""
    names = order_names(order_by)
    groups = rows.groupBy(key, *names).agg(F.count("*").alias("_copies"))
    past = running_before(
        groups, [key], order_by,
        {"_n": ("sum", "_copies"), "_sum": ("sum", F.col(value) * F.col("_copies"))}, ALL_HOT,
    )
    nth = repeat_rows(past, "_copies", "_nth", block, source=groups)
    n = F.coalesce("_n", F.lit(0)) + F.col("_nth")
    total = F.coalesce("_sum", F.lit(0)) + F.col(value) * F.col("_nth")
    return nth.select(key, *names, n.alias("running_count"), ratio(total, n).alias("running_avg"))


def windowed_average(records: DataFrame, key: str, size: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Count, sum and average of the prices per window and key."""
    n, total = F.count("*"), F.sum("price")
    return windowed(
        records, [n.alias("n"), total.alias("total"), ratio_or_zero(total, n).alias("avg_price")], size, keys=[key], ts=ts
    )


def sorted_rows(df: DataFrame, *by: str) -> DataFrame:
    return df.orderBy(*by)


def first_rows(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """The first ``n`` rows of an order. The order should be total."""
    return df.orderBy(*by).limit(n)
