"""Events as JSON text, and the records that do not decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.schema import AUCTION, BID, PERSON, with_event_time

_CORRUPT = "_corrupt_record"


def _parsed(value: str, schema: T.StructType) -> Column:
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return F.from_json(F.col(value).cast("string"), with_corrupt, options)


def decode(records: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The events of the records that decode; the others are dropped.

    Fields absent from a record are null, so ``{}`` decodes to an event of nulls. The
    one-element ``explode`` makes Spark parse a record once, not once per use of a field. A null
    record is told by its parsed form: a filter on the record itself would make Spark
    compute it once more, where it comes out of an encoder.
    """
    parsed = records.select(F.explode(F.array(_parsed(value, schema))).alias("_event"))
    good = parsed.filter(F.col("_event").isNotNull() & F.col(f"_event.{_CORRUPT}").isNull())
    return with_event_time(good.select("_event.*").drop(_CORRUPT))


def dead_letters(records: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The records ``decode`` drops, unchanged."""
    parsed = records.select("*", F.explode(F.array(_parsed(value, schema))).alias("_event"))
    return parsed.filter(F.col(value).isNull() | F.col(f"_event.{_CORRUPT}").isNotNull()).drop("_event")


def decode_bids(records: DataFrame, value: str = "value") -> DataFrame:
    return decode(records, BID, value)


def decode_auctions(records: DataFrame, value: str = "value") -> DataFrame:
    return decode(records, AUCTION, value)


def decode_persons(records: DataFrame, value: str = "value") -> DataFrame:
    return decode(records, PERSON, value)


def encode(events: DataFrame, schema: T.StructType) -> DataFrame:
    """One JSON object per event in ``value``. Absent columns are left out of it."""
    fields = [f.name for f in schema.fields if f.name in events.columns]
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def split_events(events: DataFrame, tag: int, part: str) -> DataFrame:
    """The events of one type out of a frame of tagged events."""
    return with_event_time(events.filter(F.col("event_type") == tag).select(f"{part}.*"))
