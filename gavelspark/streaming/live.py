"""Operators that go by the live watermark: results of closed windows, late rows, timers in a row.

Streams here come in micro-batches in the order of arrival. What a key brings in one micro-batch is
sorted where its order counts, so a micro-batch has to be bounded (``topic.stream`` takes a limit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators.joins import keyed_join
from gavelspark.operators.project import LOCAL_CATEGORY, LOCAL_STATES
from gavelspark.operators.scan import present
from gavelspark.streaming import processors
from gavelspark.streaming.stateful import key_part

MILLI = processors.MILLI
LATE_PARTS = 64

# Times keep their microseconds, nulls their fields.
_AS_TEXT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false",
}


def _us(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def closed_new_sellers(persons: DataFrame, auctions: DataFrame, size: str, salts: int = 1) -> DataFrame:
    """Persons and the auctions that they open in the window in which they register, once the window is over.

    Both streams have a watermark; the window is over when the smaller of the two passes its end
    (the default policy of several watermarks). Pairs are held, equal ones as a number, until then:
    each window comes once, whole. State goes with the watermark on both sides and behind the join.
    """
    p = present(persons, "id", "ts").select(F.col("id").alias("person_id"), "name", F.window("ts", size).alias("person_window"))
    a = present(auctions, "seller", "ts").select("seller", "reserve", F.window("ts", size).alias("window"))
    pairs = keyed_join(a, p, [("seller", "person_id"), ("window", "person_window")], salts=salts)
    held = pairs.groupBy("window", "person_id", "name", "reserve").agg(F.count("*").alias("pairs"))
    each = held.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("pairs").cast("int"))))
    return each.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), F.col("person_id").alias("id"), "name", "reserve"
    )


def late_rows(rows: DataFrame, size: str, delay: str, ts: str = "ts", parts: int = LATE_PARTS) -> DataFrame:
    """All rows of a stream with ``is_late`` (their window is over) and the watermark that they met (``watermark_ms``).

    The late ones are the side output: nothing is dropped. The watermark is the one that the
    micro-batch began with. Rows without a time are not late. Rows are dealt by their content, no key is in one task.
    """
    row = F.struct(*[c for c in rows.columns if c != ts])
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # without the time itself, which would have Spark drop late rows before they are told apart; the rest
    # goes through the processor as text
    plain = timed.select(F.to_json(row, _AS_TEXT).alias("body"), _us(ts).alias("at_us"), _us_of_end(ts, size).alias("end_us"))
    kind = rows.select(row.alias("row")).schema["row"].dataType
    marked = plain.withColumn("part", F.pmod(F.xxhash64("body"), F.lit(parts))).groupBy("part").transformWithStateInPandas(
        processors.LateMark(), "body string, at_us long, is_late boolean, watermark_ms long", "Append", "EventTime"
    )
    told = marked.withColumn("body", F.from_json("body", kind, _AS_TEXT))
    return told.select("body.*", F.timestamp_micros("at_us").alias(ts), "is_late", "watermark_ms")


def _us_of_end(ts: str, size: str):
    width = F.lit(micros(size))
    return _us(ts) - F.pmod(_us(ts), width) + width


def on_time_and_late(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two outputs of ``late_rows``."""
    return marked.filter(~F.col("is_late")).drop("is_late"), marked.filter("is_late").drop("is_late")


def _tagged(bids: DataFrame, auctions: DataFrame, owner: str, delay: str) -> DataFrame:
    """Both inputs as one, under one watermark; ``key`` is the auction."""
    # no nulls: they would turn whole numbers into floating-point ones
    none = F.lit(0).cast("long")
    b = present(bids, "auction", "price", "ts").select(
        F.col("auction").alias("key"), "seq", F.lit(False).alias("is_auction"), "price", _us("ts").alias("ts_us"), none.alias("expires_us"), none.alias("owner"),
        F.lit(False).alias("owned"), F.col("ts").cast("timestamp").alias("ts"),
    )
    a = present(auctions, "id", "expires", "ts").select(
        F.col("id").alias("key"), "seq", F.lit(True).alias("is_auction"), none.alias("price"), _us("ts").alias("ts_us"), _us("expires").alias("expires_us"),
        F.coalesce(F.col(owner).cast("long"), none).alias("owner"), F.col(owner).isNotNull().alias("owned"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return b.unionByName(a).withWatermark("ts", delay)


def last_sales(
    bids: DataFrame, auctions: DataFrame, delay: str, owner: str = "seller", n: int = processors.LAST_SALES, hold: str = "1 day",
) -> DataFrame:
    """Average final price of the last ``n`` closed auctions of an owner, at each closing.

    A timer at an auction's end emits its best bid before the end and clears its state. Closings go
    on to the owner's key, where a ring of ``n`` prices is kept. An auction without a bid does not count.
    Bids that come before their auction wait; ``hold`` after the watermark has passed them they go.
    """
    both = _tagged(bids, auctions, owner, delay)
    finals = both.withColumn("part", key_part("key")).groupBy("part").transformWithStateInPandas(
        processors.FinalPrice(micros(hold) // MILLI), "auction long, owner long, expires_us long, final long", "Append", "EventTime"
    )
    ring = finals.groupBy("owner").transformWithStateInPandas(
        processors.LastSales(n), "owner long, auction long, expires_us long, final long, sales long, avg_final double", "Append", "None"
    )
    return ring.select("auction", F.timestamp_micros("expires_us").alias("expires"), F.col("owner").alias(owner), "final", "sales", "avg_final")


def buffered_join(bids_and_auctions: DataFrame, delay: str, keep: str = "seller") -> DataFrame:
    """Bids on an auction that is live by its own time and by the watermark; the others wait for its next version.

    The one input has ``seq``, ``ts`` and either ``auction``, ``price`` (a bid) or ``id``, ``expires`` and
    ``keep`` (a version); ``seq`` is unique. The next version releases all waiting bids, whatever their time.
    """
    rows = present(bids_and_auctions.withColumn("_key", F.coalesce("auction", "id")), "_key", "ts")
    both = rows.select(
        F.col("_key").alias("key"), "seq", F.col("id").isNotNull().alias("is_auction"), "price", _us("ts").alias("ts_us"), _us("expires").alias("expires_us"),
        F.col(keep).cast("long").alias("owner"), F.col("ts").cast("timestamp").alias("ts"),
    ).withWatermark("ts", delay).drop("ts")
    joined = both.groupBy("key").transformWithStateInPandas(
        processors.WatermarkBuffer(), "auction long, price long, expires_us long, owner long", "Append", "EventTime"
    )
    return joined.select("auction", "price", F.timestamp_micros("expires_us").alias("expires"), F.col("owner").alias(keep))


def latest_join(
    history: DataFrame, snapshot: DataFrame | None = None, category: int = LOCAL_CATEGORY, states: Sequence[str] = LOCAL_STATES, ttl: str | None = None,
) -> DataFrame:
    """The latest auction and the latest person of a seller, at each arrival of either, in keyed state.

    ``history`` is ``asof.latest_history`` of a stream. State begins with ``snapshot``, a batch table of what earlier
    arrivals left (``latest_snapshot``): it is written once, and a micro-batch writes the parts of the keys that
    it touches, where a carried table is written whole. With ``ttl`` a side that is not renewed in that time is forgotten;
    such a stream has to be stopped, it never runs out of micro-batches.
    """
    if ttl is not None:
        pairs = _forgetful_pairs(history, snapshot, ttl)
    else:
        # as text, so that nulls do not turn whole numbers into floating-point ones
        text = lambda *fields: [F.col(f).cast("string").alias(f.rsplit(".", 1)[-1]) for f in fields]
        part = key_part("key").alias("part")
        flat = history.select(part, *text("key"), "seq", F.col("item").isNotNull().alias("is_item"), *text("item.id", "item.category", "person.name", "person.city", "person.state"))
        begin = None
        if snapshot is not None:
            sides = F.array(F.struct(F.col("item_seq").alias("seq"), F.lit(True).alias("is_item")), F.struct(F.col("person_seq").alias("seq"), F.lit(False).alias("is_item")))
            each = snapshot.withColumn("side", F.explode(sides)).filter(F.col("side.seq").isNotNull())
            begin = each.select(part, *text("key"), "side.*", *text("id", "category", "name", "city", "state")).groupBy("part")
        pairs = flat.groupBy("part").transformWithStateInPandas(
            processors.LatestPairs(), "seq long, id string, category string, name string, city string, state string", "Append", "None", initialState=begin
        ).withColumns({c: F.col(c).cast("long") for c in ("id", "category")})
    matches = pairs.filter((F.col("category") == category) & F.col("state").isin(*states))
    return matches.select("name", "city", "state", "id")


def _forgetful_pairs(history: DataFrame, snapshot: DataFrame | None, ttl: str) -> DataFrame:
    """Pairs of sides that end by the clock, each key with its own state."""
    flat = history.select(
        "key", "seq", F.col("item").isNotNull().alias("is_item"), "item.id", "item.category", "person.name", "person.city", "person.state",
    )
    begin = None if snapshot is None else snapshot.groupBy("key")
    return flat.groupBy("key").transformWithStateInPandas(
        processors.LatestPair(micros(ttl) // MILLI), "seq long, id long, category long, name string, city string, state string",
        "Append", "ProcessingTime", initialState=begin,
    )


def latest_snapshot(history: DataFrame) -> DataFrame:
    """What the arrivals of a finished history leave: the latest auction and person of each key."""
    last = history.groupBy("key").agg(F.max("item").alias("item"), F.max("person").alias("person"))
    return last.select(
        "key", F.col("item.seq").alias("item_seq"), "item.id", "item.category", F.col("person.seq").alias("person_seq"), "person.name", "person.city", "person.state",
    )
