"""The three event types and the tagged event that carries any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_L, _S = T.LongType(), T.StringType()

BID = _struct(auction=_L, bidder=_L, price=_L, dateTime=_L, extra=_S)

AUCTION = _struct(
    id=_L, itemName=_S, description=_S, initialBid=_L, reserve=_L,
    dateTime=_L, expires=_L, seller=_L, category=_L, extra=_S,
)

PERSON = _struct(
    id=_L, name=_S, emailAddress=_S, creditCard=_S,
    city=_S, state=_S, dateTime=_L, extra=_S,
)

EVENT = _struct(event_type=_L, person=PERSON, auction=AUCTION, bid=BID, dateTime=_L)

# Tags of the combined event.
PERSON_EVENT, AUCTION_EVENT, BID_EVENT = 0, 1, 2

# What a broker source yields.
BROKER_RECORD = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])


def event_time(millis: str | Column = "dateTime") -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(F.col(millis) if isinstance(millis, str) else millis)


def epoch_millis(ts: str | Column) -> Column:
    """A timestamp (with or without zone) as epoch milliseconds."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(column.cast("timestamp"))


def with_event_time(df: DataFrame) -> DataFrame:
    """Add ``ts`` next to the raw ``dateTime``; ``expires`` becomes a timestamp too."""
    df = df.withColumn("ts", event_time())
    if "expires" in df.columns:
        df = df.withColumn("expires", event_time("expires"))
    return df
