from __future__ import annotations

import random

import pytest
from fixtures import BASE, bids, tuples
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators import aggregates, windows

WAN = ("window_start", "window_end", "auction", "n")


@pytest.mark.parametrize("text, want", [
    ("90 seconds", 90_000_000), ("1 hour 30 minutes", 5_400_000_000), ("1 day", 86_400_000_000), ("5 milliseconds", 5000),
])
def test_interval_texts(text, want):
    assert micros(text) == want


@pytest.mark.parametrize("text", ["", "hour", "1 fortnight", "1"])
def test_bad_interval_texts(text):
    with pytest.raises(ValueError):
        micros(text)


def some_bids(spark, n=400):
    rng = random.Random(6)
    return bids(spark, [(0 if i % 3 else rng.randrange(5), i, i, rng.randrange(-7_200_000, 7_200_000)) for i in range(n)])


@pytest.mark.parametrize("size, slide", [
    ("60 minutes", "1 minute"), ("60 minutes", "20 minutes"), ("5 seconds", "1 second"), ("10 minutes", "10 minutes"),
    ("25 minutes", "10 minutes"),  # not a whole number of panes
    ("7 minutes", "1 minute"),  # stretches that do not divide an hour
])
def test_panes_equal_direct_windows(spark, size, slide):
    df = some_bids(spark)
    direct = windows.windowed(df, [F.count("*").alias("n")], size, slide, ["auction"])
    assert tuples(windows.sliding_counts(df, ["auction"], size, slide), *WAN) == tuples(direct, *WAN)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_panes_keep_the_time_type(spark, kind):
    df = some_bids(spark).withColumn("ts", F.col("ts").cast(kind))
    counts = windows.sliding_counts(df, ["auction"], "10 minutes", "5 minutes")
    assert dict(counts.dtypes)["window_start"] == kind == dict(counts.dtypes)["window_end"]


def test_hot_items_keep_ties(spark):
    df = bids(spark, [(1, 1, 1, 0), (1, 2, 1, 1), (2, 3, 1, 2), (2, 4, 1, 3), (3, 5, 1, 4)])
    hot = aggregates.hot_items(df, "10 seconds", "10 seconds")
    assert tuples(hot, "auction", "n") == [(1, 2), (2, 2)]


@pytest.mark.parametrize("arrival", [["seq"], [("seq", 16)], [("seq", 1)]])
def test_late_flags(spark, arrival):
    df = some_bids(spark)
    got = tuples(windows.late_flags(df, arrival, "10 minutes", "20 seconds"), "seq", "is_late")
    latest, want = None, []
    for row in sorted(df.select("seq", "dateTime").collect()):
        end = row.dateTime - row.dateTime % 600_000 + 600_000
        want.append((row.seq, latest is not None and end <= latest - 20_000))
        latest = row.dateTime if latest is None else max(latest, row.dateTime)
    assert got == want and any(late for _, late in want)


def test_closed_windows(spark):
    df = bids(spark, [(1, 1, 1, 0), (1, 2, 1, 600_000), (1, 3, 1, 1_215_000)])
    counts = windows.windowed(df, [F.count("*").alias("n")], "10 minutes")
    starts = lambda delay: windows.closed_windows(counts, df, delay).count()
    assert (starts("10 seconds"), starts("20 seconds"), starts("12 minutes")) == (2, 1, 0)


def test_day_aligned_base():
    assert BASE % 86_400_000 == 0


@pytest.mark.parametrize("size, slide", [("10 minutes", "4 minutes"), ("7 seconds", "3 seconds"), ("1 hour", "25 minutes"), ("6 minutes", "2 minutes")])
def test_panes_count_by_weight(spark, size, slide):
    df = bids(spark, [(i % 3, i, 1, i * i * 1771 % 9_000_000) for i in range(200)]).withColumn("w", F.col("bidder") % 5)
    got = windows.sliding_counts(df, ["auction"], size, slide, weight="w")
    assert tuples(got, *WAN) == tuples(windows.windowed(df, [F.sum("w").alias("n")], size, slide, ["auction"]), *WAN)
