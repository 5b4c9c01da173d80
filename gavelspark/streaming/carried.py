"""Order-dependent operators on streams, micro-batch by micro-batch.

Each micro-batch goes through the batch operator, with its care for hot keys, together with a
table of what earlier rows left behind: the best price, the sums, the last version or the
waiting rows of each key. Micro-batches have to come in the order of ``seq``, else the run fails;
rows within one may have any order. The functions are steps for ``run.run_carried``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.scalar import ratio
from gavelspark.operators import aggregates, asof
from gavelspark.operators.project import LOCAL_CATEGORY, LOCAL_STATES
from gavelspark.operators.scan import HOT_ROWS, present, running_before
from gavelspark.streaming.run import run_carried

SEQ_CHUNK = asof.SEQ_CHUNK
_PERSON = ("name", "city", "state")


def record_highs(stream: DataFrame, key: str, label: str, folder: str | None = None, tie_order: Sequence[str] = ("bidder",)) -> DataFrame:
    """The rows whose price is above every earlier price of their key."""

    def step(rows: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
        highs = aggregates.record_highs(rows, key, "seq", SEQ_CHUNK, tie_order)
        above = F.col("_best").isNull() | (F.col("price") > F.col("_best"))
        new = highs.join(best.select(F.col("key").alias("_key"), F.col("price").alias("_best")), F.col(key) == F.col("_key"), "left")
        left = best.unionByName(highs.select(F.col(key).alias("key"), "price")).groupBy("key").agg(F.max("price").alias("price"))
        return new.filter(above).drop("_key", "_best"), left

    kind = stream.schema[key].dataType.simpleString()
    return run_carried(stream, step, f"key {kind}, price long", label, folder)


def running_average(stream: DataFrame, key: str, label: str, folder: str | None = None, value: str = "price", hot_rows: float | None = HOT_ROWS) -> DataFrame:
    """Count and average of the values of the key after every row that has one."""

    def step(rows: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = present(rows, key, value)
        past = running_before(rows, [key], [("seq", SEQ_CHUNK)], {"_n": ("sum", F.lit(1)), "_sum": ("sum", value)}, hot_rows)
        held = sums.select(F.col("key").alias("_key"), F.col("n").alias("_held"), F.col("total").alias("_total"))
        n = F.coalesce("_n", F.lit(0)) + F.coalesce("_held", F.lit(0)) + 1
        total = F.coalesce("_sum", F.lit(0)) + F.coalesce("_total", F.lit(0)) + F.col(value)
        averaged = past.join(held, F.col(key) == F.col("_key"), "left").select(
            *rows.columns, n.cast("long").alias("running_count"), ratio(total, n).alias("running_avg")
        )
        own = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        return averaged, sums.unionByName(own).groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    kind = stream.schema[key].dataType.simpleString()
    return run_carried(stream, step, f"key {kind}, n long, total long", label, folder)


def tagged(auctions: DataFrame, persons: DataFrame) -> DataFrame:
    """Both inputs as one stream, so that they arrive in one order; ``kind`` tells them apart."""
    a = auctions.select(F.lit("a").alias("kind"), "seq", F.col("seller").alias("key"), "id", *[c for c in ("category",) if c in auctions.columns])
    p = persons.select(F.lit("p").alias("kind"), "seq", F.col("id").alias("key"), *_PERSON)
    return a.unionByName(p, allowMissingColumns=True)


def _items(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.filter("kind = 'a'").select("seq", "id", F.col("key").alias("seller"), *fields)


def _people(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'p'").select("seq", F.col("key").alias("id"), *_PERSON)


def pending_join(auctions: DataFrame, persons: DataFrame, label: str, folder: str | None = None, states: Sequence[str] = LOCAL_STATES) -> DataFrame:
    """Every auction once: with the seller as known when it arrives, or with the first one that comes."""

    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        # persons of other states are as if they had not come; waiting auctions come again
        rows = rows.filter((F.col("kind") == "a") | F.col("state").isin(*states))
        both = present(rows.select(*held.columns).unionByName(held), "key")
        joined = asof.pending_join(_items(both), _people(both), states)
        latest = both.filter("kind = 'p'").groupBy("key").agg(F.max(F.struct("seq", *_PERSON)).alias("last"))
        known = latest.select(F.lit("p").alias("kind"), "last.seq", "key", F.lit(None).cast("long").alias("id"), *[f"last.{f}" for f in _PERSON])
        waiting = both.filter("kind = 'a'").join(latest, "key", "left_anti").groupBy("key", "id").agg(F.min("seq").alias("seq"))
        waiting = waiting.select(F.lit("a").alias("kind"), "seq", "key", "id", *[F.lit(None).cast("string").alias(f) for f in _PERSON])
        return joined, known.unionByName(waiting)

    return run_carried(
        tagged(auctions, persons), step, "kind string, seq long, key long, id long, name string, city string, state string", label, folder
    )


def latest_join(
    auctions: DataFrame, persons: DataFrame, label: str, folder: str | None = None, category: int = LOCAL_CATEGORY,
    states: Sequence[str] = LOCAL_STATES, prefilter: bool = False,
) -> DataFrame:
    """The latest auction and the latest person, at each arrival of either."""

    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = asof.latest_history(_items(rows, "category"), _people(rows), states, prefilter)
        both = new.withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False)))
        pairs = asof.latest_pairs(both, category, states, emits=F.col("_new"))
        left = both.groupBy("key").agg(F.max("seq").alias("seq"), F.max("item").alias("item"), F.max("person").alias("person"))
        return pairs, left

    carried = "key long, seq long, item struct<seq: long, id: long, category: long>, person struct<seq: long, name: string, city: string, state: string>"
    return run_carried(tagged(auctions, persons), step, carried, label, folder)


def buffered_join(bids: DataFrame, auctions: DataFrame, label: str, folder: str | None = None, keep: Sequence[str] = ("seller",)) -> DataFrame:
    """Bids on a live auction, and bids that waited for the next version of theirs."""
    b = bids.select(F.lit("b").alias("kind"), "seq", F.col("auction").alias("key"), "price", "ts")
    a = auctions.select(F.lit("a").alias("kind"), "seq", F.col("id").alias("key"), "expires", *keep)
    both = b.unionByName(a, allowMissingColumns=True)
    columns = both.columns

    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = present(rows.unionByName(held), "key")
        offers = rows.filter("kind = 'b'").select(F.col("key").alias("auction"), "seq", "price", "ts")
        versions = rows.filter("kind = 'a'").select(F.col("key").alias("id"), "seq", "expires", *keep)
        met = asof.met_bids(offers, versions, keep)
        waiting = met.filter("_met is null").select(F.lit("b").alias("kind"), "seq", "key", "bid.price", "bid.ts")
        last = versions.groupBy("id").agg(F.max(F.struct("seq", "expires", *keep)).alias("last"))
        last = last.select(F.lit("a").alias("kind"), "last.seq", F.col("id").alias("key"), "last.expires", *[f"last.{k}" for k in keep])
        return asof.released(met, keep), waiting.unionByName(last, allowMissingColumns=True).select(*columns)

    return run_carried(both, step, both.schema, label, folder)

