"""The events table sent to a topic and read back as a live stream, batch by batch in the order of arrival."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.session import shared_folder
from gavelspark.sources import topic
from gavelspark.sources.tables import read_table

# Messages of a topic partition, about, and partitions of a small table.
PARTITION_ROWS = 20_000_000
LEAST_PARTITIONS = 4
# A small table comes in so many micro-batches; a large one in micro-batches of so many messages of each partition.
BATCHES = 4
BATCH_ROWS = 1 << 20
# Events within a block of arrivals are dealt out of order: the place in the block times this, modulo the block.
BLOCK, STRIDE = 128, 37

_BODY = "event_id long, user_id long, event_type string, value double, props string, arrival long"


@dataclass
class Replay:
    """A topic of events, with what a micro-batch takes of each partition."""

    spark: SparkSession
    path: str
    per_batch: int

    def stream(self, group: str | None = None, starting: str = topic.COMMITTED) -> DataFrame:
        """Each call is a reader of its own, with its own offsets."""
        return events_of(topic.stream(self.spark, self.path, group, starting, self.per_batch, uuid.uuid4().hex))


def events_of(records: DataFrame) -> DataFrame:
    """Events out of messages; ``ts`` is the time of the message."""
    body = records.select(F.from_json("value", _BODY).alias("body"), F.col("timestamp").alias("ts"), "partition", "offset")
    return body.select("body.*", "ts", "partition", "offset")


def in_order() -> Column:
    return F.col("event_id")


def out_of_order() -> Column:
    """Arrival numbers: up to a block of events early or late."""
    number = F.col("event_id")
    return number - F.pmod(number, F.lit(BLOCK)) + F.pmod(number * STRIDE, F.lit(BLOCK))


def sent(events: DataFrame, path: str, arrival: Column, partitions: int) -> None:
    """Send events in the order of arrival: number ``arrival`` goes to the partition of its remainder."""
    placed = events.withColumn("arrival", arrival.cast("long"))
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props", "arrival"))
    rows = placed.withColumn("_number", F.pmod("arrival", F.lit(partitions)).cast("int"))
    dealt = rows.repartition(partitions, "_number").sortWithinPartitions("_number", "arrival")
    topic.send(topic.messages(dealt, body, F.col("ts"), F.col("_number"), F.col("user_id")), path)


def partitions_of(n: int) -> int:
    return max(LEAST_PARTITIONS, -(-n // PARTITION_ROWS))


def per_batch_of(n: int) -> int:
    return max(1, min(BATCH_ROWS, -(-n // (BATCHES * partitions_of(n)))))


def replay(spark: SparkSession, sf_dir: str, label: str, arrival: Column | None = None) -> Replay:
    """The events table as a topic in the shared folder."""
    events, path = read_table(spark, sf_dir, "events"), shared_folder(spark, label)
    n = events.count()
    sent(events, path, in_order() if arrival is None else arrival, partitions_of(n))
    return Replay(spark, path, per_batch_of(n))


# The same order of arrival as SQL: the events with ``arrival``, topic partition ``part``, ``pos`` in it and micro-batch ``batch``.
OUT_OF_ORDER_SQL = f"event_id - event_id % {BLOCK} + (event_id * {STRIDE}) % {BLOCK}"
_SIZES_SQL = f"""SELECT n, parts, greatest(1, least({BATCH_ROWS}, CAST(ceil(n / ({BATCHES} * parts)) AS BIGINT))) AS per_batch
    FROM (SELECT count(*) AS n, greatest({LEAST_PARTITIONS}, CAST(ceil(count(*) / {PARTITION_ROWS}) AS BIGINT)) AS parts FROM events)"""


def arrived_sql(arrival: str = "event_id") -> str:
    return f"""sizes AS ({_SIZES_SQL}),
    numbered AS (SELECT events.*, {arrival} AS arrival, ({arrival}) % parts AS part, per_batch FROM events, sizes),
    placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY arrival) - 1 AS pos FROM numbered),
    arrived AS (SELECT *, pos // per_batch AS batch FROM placed)"""


def watermarks_sql(delay_ms: int) -> str:
    """By micro-batch the watermark that holds in it, in milliseconds; zero in the first."""
    return f"""watermarks AS (SELECT batch, coalesce(max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {delay_ms}, 0) AS wm
                FROM (SELECT batch, max(epoch_us(ts)) // 1000 AS latest FROM arrived GROUP BY batch))"""
