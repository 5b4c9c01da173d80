"""Order-dependent joins: each row meets what the other side was when it arrived.

The batch forms give what the stateful stream operators emit when the rows arrive in
``seq`` order. ``seq`` must be unique over both inputs. Sellers of any size are fine:
the histories are scanned in chunks of ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.project import LOCAL_CATEGORY, LOCAL_STATES, in_states
from gavelspark.operators.scan import ALL_HOT, HOT_ROWS, NONE_HOT, OrderBy, present, running_before, split_keys

SEQ_CHUNK = 1 << 20
_PERSON_FIELDS = ("name", "city", "state")


def _tagged(auctions: DataFrame, persons: DataFrame, item_fields: Sequence[str]) -> DataFrame:
    """Both inputs under one key, with their fields in ``item`` or ``person``."""
    a = auctions.select(F.col("seller").alias("key"), "seq", F.struct("seq", *item_fields).alias("item"))
    p = persons.select(F.col("id").alias("key"), "seq", F.struct("seq", *_PERSON_FIELDS).alias("person"))
    return present(a.unionByName(p, allowMissingColumns=True), "key")


def pending_join(
    auctions: DataFrame, persons: DataFrame, states: Sequence[str] = LOCAL_STATES, chunk: int = SEQ_CHUNK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """Every auction once, with the seller as known at that moment.

    An auction takes the last person version before it. If there is none it waits, as
    one of a set of ids, for the seller's first version.
    """
    persons = in_states(persons, states)
    history = _tagged(auctions, persons, ["id"])
    known = running_before(history, ["key"], [("seq", chunk)], {"known": ("max", "person")}, hot_rows).filter(
        F.col("item").isNotNull()
    )
    at_once = known.filter(F.col("known").isNotNull()).select(
        *[F.col(f"known.{f}").alias(f) for f in _PERSON_FIELDS], F.col("item.id").alias("id")
    )
    waiting = known.filter(F.col("known").isNull()).select("key", F.col("item.id").alias("id")).distinct()
    first = persons.groupBy(F.col("id").alias("first_key")).agg(
        F.min(F.struct("seq", *_PERSON_FIELDS)).alias("first")
    )
    later = waiting.join(first, F.col("key") == F.col("first_key")).select(
        *[F.col(f"first.{f}").alias(f) for f in _PERSON_FIELDS], "id"
    )
    return at_once.unionByName(later)


def latest_join(
    auctions: DataFrame, persons: DataFrame, category: int = LOCAL_CATEGORY,
    states: Sequence[str] = LOCAL_STATES, prefilter: bool = False, chunk: int = SEQ_CHUNK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """The latest auction and the latest person of a seller, at each arrival of either.

    The filters apply to the pair, after "latest" is settled. ``prefilter`` drops persons
    of other states before, so that moving away leaves the old version in force.
    """
    history = latest_history(auctions, persons, states, prefilter)
    return latest_pairs(history, category, states, chunk, hot_rows)


def latest_history(
    auctions: DataFrame, persons: DataFrame, states: Sequence[str] = LOCAL_STATES, prefilter: bool = False
) -> DataFrame:
    """Arrivals of both inputs by seller: ``key``, ``seq``, and ``item`` or ``person``."""
    return _tagged(auctions, in_states(persons, states) if prefilter else persons, ["id", "category"])


def latest_pairs(
    history: DataFrame, category: int = LOCAL_CATEGORY, states: Sequence[str] = LOCAL_STATES, chunk: int = SEQ_CHUNK,
    hot_rows: float | None = HOT_ROWS, emits: Column | None = None,
) -> DataFrame:
    """The pair at each arrival of a history; ``emits`` tells the arrivals that count."""
    seen = running_before(
        history, ["key"], [("seq", chunk)], {"last_item": ("max", "item"), "last_person": ("max", "person")},
        hot_rows,
    )
    pairs = (seen if emits is None else seen.filter(emits)).select(
        F.coalesce("item", "last_item").alias("item"), F.coalesce("person", "last_person").alias("person")
    )
    matches = (F.col("item.category") == category) & F.col("person.state").isin(*states)
    return pairs.filter(matches).select(
        *[F.col(f"person.{f}").alias(f) for f in _PERSON_FIELDS], F.col("item.id").alias("id")
    )


def with_arrival_watermark(
    rows: DataFrame, delay: str, order_by: OrderBy = (("seq", SEQ_CHUNK),), ts: str = "ts"
) -> DataFrame:
    """Add the watermark each row meets: the latest earlier event time, less the delay."""
    seen = running_before(rows, [], order_by, {"_latest": ("max", ts)})
    return seen.withColumn("watermark", F.col("_latest") - F.expr(f"interval {delay}")).drop("_latest")


def buffered_join(
    bids: DataFrame, auctions: DataFrame, keep: Sequence[str] = ("seller",), chunk: int = SEQ_CHUNK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """Bids that wait for their auction, and bids on a live one.

    A bid meets the last version of its auction before it if that ends after the bid and
    after the bid's ``watermark`` (where the column is there and not null). All other bids
    wait for the next version of the auction and are then released whatever their time.
    """
    return released(met_bids(bids, auctions, keep, chunk, hot_rows), keep)


def released(met: DataFrame, keep: Sequence[str] = ("seller",)) -> DataFrame:
    """The joined rows of the bids that met a version."""
    return met.filter(F.col("_met").isNotNull()).select(
        F.col("_met.id").alias("auction"), F.col("bid.price").alias("price"), F.col("_met.expires").alias("expires"),
        *[F.col(f"_met.{k}").alias(k) for k in keep],
    )


def met_bids(
    bids: DataFrame, auctions: DataFrame, keep: Sequence[str] = ("seller",), chunk: int = SEQ_CHUNK,
    hot_rows: float | None = HOT_ROWS,
) -> DataFrame:
    """Every bid (``key``, ``seq``, ``bid``) with the version ``_met`` that it is joined to; null if it still waits."""
    fields = ["id", "expires", *keep]
    has_watermark = "watermark" in bids.columns
    offer = ["price", "ts", *(["watermark"] if has_watermark else [])]
    b = bids.select(F.col("auction").alias("key"), "seq", F.struct("seq", *offer).alias("bid"))
    a = auctions.select(F.col("id").alias("key"), "seq", F.struct("seq", *fields).alias("item"))
    history = present(b.unionByName(a, allowMissingColumns=True), "key")
    if hot_rows in (ALL_HOT, NONE_HOT):
        both = _last_and_next(history, chunk, hot_rows)
    else:
        # split once for both scans
        cold, hot = split_keys(history, ["key"], hot_rows)
        both = _last_and_next(cold, chunk, NONE_HOT).unionByName(_last_and_next(hot, chunk, ALL_HOT))
    both = both.filter(F.col("bid").isNotNull())
    live = F.col("_last").isNotNull() & (F.col("_last.expires") > F.col("bid.ts"))
    if has_watermark:
        live = live & (F.col("bid.watermark").isNull() | (F.col("_last.expires") > F.col("bid.watermark")))
    met = F.when(F.coalesce(live, F.lit(False)), F.col("_last")).otherwise(F.col("_next.item"))
    return both.select("key", "seq", "bid", met.alias("_met"))


def _last_and_next(history: DataFrame, chunk: int, hot_rows: float | None) -> DataFrame:
    """Add the auction version before each row and the one after it."""
    # "next" is "last" in the reversed order
    upcoming = history.withColumn("_back", -F.col("seq")).withColumn(
        "_upcoming",
        F.when(F.col("item").isNotNull(), F.struct((-F.col("item.seq")).alias("order"), F.col("item").alias("item"))),
    )
    nexts = running_before(upcoming, ["key"], [("_back", chunk)], {"_next": ("max", "_upcoming")}, hot_rows)
    return running_before(
        nexts.select("key", "seq", "bid", "item", "_next"), ["key"], [("seq", chunk)], {"_last": ("max", "item")}, hot_rows
    )
