"""Window results with ties on streams.

Batch compares rows with their window's maximum by a join. On a stream the maximum of a
window is final when the window closes. It is then joined to the rows that wait for it,
by window and value; nothing is gathered per window, and the watermark drops the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.windows import flat_window


def hot_items_stream(bids: DataFrame, size: str = "60 minutes", slide: str = "1 minute") -> DataFrame:
    """The auctions with the most bids per closed sliding window; ``bids`` has a watermark."""

    def counts(one: Column) -> DataFrame:
        panes = bids.groupBy(F.window("ts", slide).alias("pane"), "auction").agg(one.alias("_n"))
        return panes.groupBy(F.window("pane", size, slide), "auction").agg(F.sum("_n").alias("n"))

    # The two sides must not be equal plans: a reused exchange hides the watermark from
    # the side that reuses it, and its windows then never close.
    rows, again = F.count("*"), F.sum(F.lit(1).cast("long"))
    best = counts(again).groupBy(F.col("window").alias("best_window")).agg(F.max("n").alias("best"))
    hot = counts(rows).join(best, (F.col("window") == F.col("best_window")) & (F.col("n") == F.col("best")))
    return flat_window(hot.select("window", "auction", "n"))


def highest_bids_stream(bids: DataFrame, size: str = "10 minutes") -> DataFrame:
    """All bids at the highest price of their closed window; ``bids`` has a watermark."""
    best = bids.groupBy(F.window("ts", size).alias("best_window")).agg(F.max("price").alias("best"))
    placed = bids.select(F.window("ts", size).alias("window"), "auction", "price", "bidder")
    top = placed.join(best, (F.col("window") == F.col("best_window")) & (F.col("price") == F.col("best")))
    return flat_window(top.select("window", "auction", "price", "bidder"))
