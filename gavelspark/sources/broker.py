"""Broker topics as sources and sinks. The connector package comes with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from gavelspark.sources.codec import decode, encode


def source_options(servers: str, topic: str, group: str | None = None, starting: str = "earliest") -> dict[str, str]:
    """Options of a topic scan.

    A stream goes on from its checkpoint; ``starting`` is only for the first run, which is
    "committed, else earliest". For "always earliest" run with a new checkpoint folder.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    return options


def sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def read_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The whole topic as it is now."""
    return spark.read.format("kafka").options(**options).load()


def stream_topic(spark: SparkSession, options: dict[str, str], per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**options)
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load()


def message_values(records: DataFrame) -> DataFrame:
    """Message texts; keys are ignored."""
    return records.select(F.col("value").cast("string").alias("value"))


def decode_topic(records: DataFrame, schema: T.StructType) -> DataFrame:
    return decode(message_values(records), schema)


def events_to_topic(events: DataFrame, schema: T.StructType, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    """A stream of events on its way to a topic; delivery is at least once."""
    return (
        encode(events, schema).writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
    )
