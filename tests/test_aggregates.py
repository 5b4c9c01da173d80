from __future__ import annotations

import random

import pytest
from fixtures import (
    BASE, EVERY_WINDOW, FIVE_AUCTIONS, HIGHEST, MIN, PER_MINUTE, REVERSED, STRAGGLERS, bids, joined, tuples,
)
from pyspark.sql import functions as F

from gavelspark.operators import aggregates

APB = ("auction", "price", "bidder")


def highest(spark, rows, size="10 minutes"):
    return tuples(aggregates.highest_bid_per_auction(bids(spark, rows), size), *APB)


def test_highest_bid_per_auction(spark):
    assert highest(spark, HIGHEST) == [(1, 60, 6), (2, 40, 4)]


def test_highest_bid_of_window(spark):
    assert tuples(aggregates.highest_bids(bids(spark, HIGHEST)), *APB) == [(1, 60, 6)]


@pytest.mark.parametrize("shift, want", [(5 * MIN, [(1, 300, 2)]), (0, [(1, 50, 1), (1, 300, 2)])])
def test_window_boundary(spark, shift, want):
    assert highest(spark, [(1, 1, 50, shift - 10_000), (1, 2, 300, shift)]) == want


def test_one_bid_per_window(spark):
    assert highest(spark, EVERY_WINDOW) == sorted((1, 10 * i, i) for i in range(300))


def test_low_stragglers_change_nothing(spark):
    assert highest(spark, STRAGGLERS) == sorted((1, 10 * i, i) for i in range(1000))


def test_many_bids_per_window(spark):
    got = highest(spark, PER_MINUTE)
    assert len(got) == 101 and got[:2] == [(1, 90, 9), (1, 190, 19)]


def test_several_auctions(spark):
    assert highest(spark, FIVE_AUCTIONS) == [(a, 1000 - a, a) for a in range(5)]


def test_reversed_times(spark):
    assert highest(spark, REVERSED) == [(1, 1000, 0)]


def test_ties(spark):
    tie = bids(spark, [(1, 7, 50, 0), (1, 8, 50, 0)])
    later = aggregates.highest_bid_per_auction(tie, tie_order=["seq"])
    assert tuples(later, *APB) == [(1, 50, 8)]
    assert tuples(aggregates.highest_bids(tie), *APB) == [(1, 50, 7), (1, 50, 8)]


# Fixed values: (key, price, offset), whose averages are known.
BY_CATEGORY = [
    (1, 10, 0), (1, 20, 0), (1, 30, 0), (1, 40, 1000), (1, 50, 1500), (1, 60, 750),
    (2, 20, 1000), (2, 30, 750), (2, 40, 1500),
]


def averages(spark, rows, position, chunk, hot_rows=None):
    rows = joined(spark, rows)
    high = aggregates.record_highs(rows, "key", position, chunk, ["ts"] if position == "seq" else ["seq"], hot_rows)
    return tuples(aggregates.windowed_average(high, "key"), "key", "n", "total", "avg_price")


@pytest.mark.parametrize("hot_rows", [None, 0, 4, 100])
@pytest.mark.parametrize("chunk", [1, 2, 1 << 20])
def test_record_highs_by_arrival(spark, chunk, hot_rows):
    assert averages(spark, BY_CATEGORY, "seq", chunk, hot_rows) == [(1, 6, 210, 35.0), (2, 3, 90, 30.0)]


@pytest.mark.parametrize("hot_rows", [None, 4, 100])
@pytest.mark.parametrize("chunk", ["500 milliseconds", "1 hour"])
def test_record_highs_by_event_time(spark, chunk, hot_rows):
    assert averages(spark, BY_CATEGORY, "ts", chunk, hot_rows) == [(1, 4, 120, 30.0), (2, 2, 70, 35.0)]


def test_record_highs_in_two_rounds(spark):
    rows = [(1, 550, 1000), (2, 350, 6000), (1, 560, 500), (2, 360, 8000)]
    assert averages(spark, rows, "seq", 1) == [(1, 2, 1110, 555.0), (2, 2, 710, 355.0)]


def test_averages_by_seller(spark):
    rows = [(1, 20, 0), (1, 30, 0), (2, 40, 0), (2, 50, 0), (3, 60, 0), (3, 70, 0), (4, 80, 0), (4, 90, 0)]
    assert [(k, avg) for k, _, _, avg in averages(spark, rows, "seq", 4)] == [(1, 25.0), (2, 45.0), (3, 65.0), (4, 85.0)]


@pytest.mark.parametrize("order", [
    [("ts", "1 second"), ("price", 2), "bidder"], [("ts", "1 hour"), "price", "bidder"],
])
@pytest.mark.parametrize("block, hot_rows", [(20, None), (20, 200), (1 << 20, None), (1 << 20, 10_000)])
def test_running_average_with_copies(spark, order, block, hot_rows):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.5 else 2, rng.randrange(6), 1000 * rng.randrange(5)) for _ in range(300)]
    # a third of all rows are copies of one row
    rows += [(1, 3, 2000)] * 150
    df = joined(spark, rows).withColumn("bidder", F.lit(0).cast("long"))
    got = tuples(aggregates.running_average(df, "key", order, block=block, hot_rows=hot_rows), "key", "running_count", "running_avg")
    want = []
    for key in (1, 2):
        n = total = 0
        for _, price in sorted((t, p) for k, p, t in rows if k == key):
            n, total = n + 1, total + price
            want.append((key, n, total / n))
    assert got == want


@pytest.mark.parametrize("block, hot_rows", [(10, None), (12, 100), (1 << 16, None), (12, 10_000)])
def test_moving_average_in_blocks(spark, block, hot_rows):
    rng = random.Random(4)
    rows = [(1 if i % 3 else 2, BASE + 1000 * rng.randrange(20), i, rng.randrange(100)) for i in range(200)]
    df = spark.createDataFrame(rows, "seller long, expires long, auction long, final long")
    order = [("expires", 5000), ("auction", 16)]
    averaged = aggregates.moving_average(df, "seller", order, "final", 10, block, hot_rows)
    got = tuples(averaged, "auction", "sales", "avg_final")
    want = []
    for seller in (1, 2):
        prices = []
        for _, _, auction, price in sorted((r for r in rows if r[0] == seller), key=lambda r: (r[1], r[2])):
            prices = (prices + [price])[-10:]
            want.append((auction, len(prices), sum(prices) / len(prices)))
    assert got == sorted(want)


def test_average_of_highest_valid_bids(spark):
    auctions = spark.createDataFrame(
        [(1, 7, BASE, BASE + 1000), (2, 7, BASE, BASE + 1000), (3, 8, BASE, BASE + 1000)],
        "id long, category long, dateTime long, end long",
    ).select("id", "category", F.timestamp_millis("dateTime").alias("ts"), F.timestamp_millis("end").alias("expires"))
    offers = bids(spark, [(1, 1, 10, 0), (1, 2, 30, 10), (1, 3, 99, 2000), (2, 1, 50, 5), (3, 1, 5, -5), (3, 1, 4, 5)])
    got = tuples(aggregates.avg_price_by_category(offers, auctions), "category", "auctions", "avg_price")
    assert got == [(7, 2, 40.0), (8, 1, 4.0)]
    early = aggregates.avg_price_by_category(offers, auctions, aggregates.BEFORE_EXPIRY)
    assert tuples(early, "category", "avg_price") == [(7, 40.0), (8, 5.0)]


def test_max_price_bid(spark):
    assert tuples(aggregates.max_price_bid(bids(spark, HIGHEST)), *APB) == [(1, 60, 6), (2, 40, 4)]


@pytest.mark.parametrize("last, block", [(10, 4), (10, 3), (25, 4), (5, 1), (4, 4), (5, 4)])
def test_frames_longer_than_a_block(spark, last, block):
    rows = [(i % 2, i, None if i % 11 == 4 else (i * 37) % 101) for i in range(60)]
    df = spark.createDataFrame(rows, "seller long, at long, final long")
    got = [
        tuples(aggregates.moving_average(df, "seller", [("at", 8)], "final", last, block, hot_rows), "seller", "at", "sales", "avg_final")
        for hot_rows in (None, 1 << 22, 5)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == sum(r[2] is not None for r in rows)
