"""Small inputs with known results. Times are milliseconds after a day-aligned base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1704067200000  # 2024-01-01T00:00:00Z
MIN = 60_000


def bids(spark: SparkSession, rows) -> DataFrame:
    """(auction, bidder, price, offset ms) in arrival order."""
    numbered = [(a, b, p, BASE + t, i) for i, (a, b, p, t) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "auction long, bidder long, price long, dateTime long, seq long")
    return df.withColumn("ts", F.timestamp_millis("dateTime"))


def joined(spark: SparkSession, rows) -> DataFrame:
    """Joined bids (key, price, offset ms) in arrival order."""
    numbered = [(k, p, BASE + t, i, i) for i, (k, p, t) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "key long, price long, dateTime long, seq long, bidder long")
    return df.withColumn("ts", F.timestamp_millis("dateTime")).withColumn("auction", F.lit(1).cast("long"))


def auctions(spark: SparkSession, rows) -> DataFrame:
    """(seq, id, seller, category)."""
    return spark.createDataFrame(rows, "seq long, id long, seller long, category long")


def persons(spark: SparkSession, rows) -> DataFrame:
    """(seq, id, name, city, state)."""
    return spark.createDataFrame(rows, "seq long, id long, name string, city string, state string")


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


# The highest-bid inputs.
# Bids whose highest ones are known.
HIGHEST = [
    (1, 1, 10, 0), (1, 2, 20, 0), (1, 3, 30, 0), (1, 4, 40, 1000), (1, 5, 50, 1500), (1, 6, 60, 750),
    (2, 2, 20, 1000), (2, 3, 30, 750), (2, 4, 40, 1500),
]
EVERY_WINDOW = [(1, i, 10 * i, i * 10 * MIN) for i in range(300)]
STRAGGLERS = [(1, i, 10 * i, i * 10 * MIN) for i in range(1000)] + [
    (1, 1000 + j, j, 999 * 10 * MIN) for j in range(100)
]
PER_MINUTE = (
    [(1, i, 10 * i, i * MIN) for i in range(1000)]
    + [(1, 1000 + j, j, 990 * MIN) for j in range(100)]
    + [(1, 1100, 1000, 1000 * MIN)]
)
FIVE_AUCTIONS = [(i % 5, i, 1000 - i, 100 * i) for i in range(500)]
REVERSED = [(1, i, 1000 - i, 100 * i) for i in range(100, -1, -1)]

# The local-items inputs.
# Sellers and their items, two of them local.
PEOPLE = [
    (0, 1, "Alice", "Portland", "OR"), (1, 2, "Bob", "Boise", "ID"),
    (2, 3, "Charlie", "San Diego", "CA"), (3, 4, "David", "Reno", "NV"),
]
ITEMS = [(4, 1, 1, 10), (5, 2, 3, 9), (6, 3, 2, 10), (7, 4, 4, 10)]
LOCAL = [("Alice", "Portland", "OR", 1), ("Bob", "Boise", "ID", 3)]

# Auctions before, between and after two versions of their seller.
VERSION_ITEMS = [(0, 10, 1, 10), (1, 11, 1, 10), (3, 12, 1, 10)]
VERSIONS = [(2, 1, "Ann", "Bend", "OR"), (4, 1, "Ann", "Salem", "OR")]
