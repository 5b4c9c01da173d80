"""Queries on single events: conversion, filters, texts, codecs, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions import scalar
from gavelspark.operators import aggregates, project
from gavelspark.plans.registry import query
from gavelspark.schema import AUCTION, BID, BID_EVENT, PERSON, epoch_millis
from gavelspark.sources import codec, generate, tables

AS_OF = "2002-01-01 00:00:00"


@query("q1_currency", """
    SELECT auction, CAST(trunc(CAST(0.82 AS FLOAT) * CAST(price AS FLOAT)) AS BIGINT) AS price, bidder, ts
    FROM bid""", "bid")
def q1_currency(spark, sf_dir):
    return project.currency_conversion(tables.bids(spark, sf_dir))


@query("state_filter", "SELECT * FROM person WHERE state IN ('OR', 'ID', 'CA')", "person")
def state_filter(spark, sf_dir):
    return project.in_states(tables.persons(spark, sf_dir))


@query("category_filter", "SELECT * FROM auction WHERE category = 10", "auction")
def category_filter(spark, sf_dir):
    return project.in_category(tables.auctions(spark, sf_dir))


@query("auction_closed", f"SELECT * FROM auction WHERE expires < TIMESTAMP '{AS_OF}'", "auction")
def auction_closed(spark, sf_dir):
    return project.closed_auctions(tables.auctions(spark, sf_dir), AS_OF)


@query("auction_live", f"SELECT * FROM auction WHERE expires > TIMESTAMP '{AS_OF}'", "auction")
def auction_live(spark, sf_dir):
    return project.live_auctions(tables.auctions(spark, sf_dir), AS_OF)


@query("scalar_functions", """
    SELECT auction, bidder, greatest(price, auction) AS larger,
           CAST(price AS DOUBLE) / (bidder + 1) AS per_bidder,
           CASE WHEN price % 3 = 0 THEN 0.0 ELSE CAST(price AS DOUBLE) / (price % 3) END AS guarded,
           strftime(ts, '%H:%M:%S') AS clock, epoch_us(ts) // 1000 AS millis,
           '(' || auction || ',' || price || ')' AS pair
    FROM ebid""", "ebid")
def scalar_functions(spark, sf_dir):
    bids = tables.event_bids(spark, sf_dir)
    return bids.select(
        "auction", "bidder",
        scalar.later("price", "auction").alias("larger"),
        scalar.ratio("price", F.col("bidder") + 1).alias("per_bidder"),
        scalar.ratio_or_zero("price", F.col("price") % 3).alias("guarded"),
        scalar.clock_time("ts").alias("clock"),
        epoch_millis("ts").alias("millis"),
        scalar.pair_text("auction", "price").alias("pair"),
    )


@query("bid_codec", """
    SELECT auction, bidder, price, epoch_us(ts) // 1000 AS "dateTime", ts FROM bid""", "bid")
def bid_codec(spark, sf_dir):
    bids = tables.bids(spark, sf_dir).withColumn("dateTime", epoch_millis("ts"))
    decoded = codec.decode_bids(codec.encode(bids, BID))
    return decoded.select("auction", "bidder", "price", "dateTime", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("auction_codec", "SELECT id, seller, category, reserve, ts, expires FROM auction", "auction")
def auction_codec(spark, sf_dir):
    auctions = tables.auctions(spark, sf_dir).withColumn("dateTime", epoch_millis("ts")).withColumn(
        "expires", epoch_millis("expires")
    )
    decoded = codec.decode_auctions(codec.encode(auctions, AUCTION))
    zone_free = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("ts", "expires")]
    return decoded.select("id", "seller", "category", "reserve", *zone_free)


@query("person_codec", "SELECT id, name, city, state, ts FROM person", "person")
def person_codec(spark, sf_dir):
    persons = tables.persons(spark, sf_dir).withColumn("dateTime", epoch_millis("ts"))
    decoded = codec.decode_persons(codec.encode(persons, PERSON))
    return decoded.select("id", "name", "city", "state", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _mixed_records(spark, sf_dir):
    """Events as messages: errors are no JSON, views carry text where a number belongs."""
    bids = tables.events(spark, sf_dir).select(
        "event_type", "event_id",
        F.to_json(F.struct((F.col("user_id") % 20).alias("auction"), F.col("event_id").alias("bidder"))).alias("good"),
    )
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("garbage "), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"auction":"x'), F.col("event_id").cast("string"), F.lit('"}')))
        .otherwise(F.col("good"))
    )
    return bids.select(message.alias("value"))


@query("drop_malformed", """
    SELECT user_id % 20 AS auction, event_id AS bidder FROM events WHERE event_type NOT IN ('error', 'view')""")
def drop_malformed(spark, sf_dir):
    return codec.decode_bids(_mixed_records(spark, sf_dir)).select("auction", "bidder")


@query("dead_letters", """
    SELECT CASE WHEN event_type = 'error' THEN 'garbage ' || event_id
                ELSE '{"auction":"x' || event_id || '"}' END AS value
    FROM events WHERE event_type IN ('error', 'view')""")
def dead_letters(spark, sf_dir):
    return codec.dead_letters(_mixed_records(spark, sf_dir), BID)


@query("event_split", """
    SELECT user_id % 20 AS auction, event_id AS bidder, CAST(round(value * 100) AS BIGINT) AS price,
           epoch_us(ts) // 1000 AS "dateTime"
    FROM events WHERE event_type NOT IN ('signup', 'purchase')""")
def event_split(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    tag = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(BID_EVENT)
    bid = F.struct(
        (F.col("user_id") % 20).alias("auction"), F.col("event_id").alias("bidder"),
        tables.minor_units("value").alias("price"), epoch_millis("ts").alias("dateTime"),
    )
    tagged = events.select(tag.alias("event_type"), F.when(tag == BID_EVENT, bid).alias("bid"))
    return codec.split_events(tagged, BID_EVENT, "bid").drop("ts")


# The generator's arithmetic in SQL.
def _mixed(n: str, salt: int) -> str:
    seed = f"((({n}) + {salt * 7919}) % 2147483647 + 1)"
    return f"(({seed} * 48271 % 2147483647) * 69621 % 2147483647)"


def _pick(options, number: str) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[CAST({number} % {len(options)} AS INTEGER) + 1]"


def _recent(n: str, known: str, salt: int) -> str:
    hot, recent = f"({known}) - ({known}) % 100", f"greatest(({known}) - {_mixed(n, salt + 1)} % 100, 0)"
    return f"(1000 + CASE WHEN {_mixed(n, salt)} % 4 > 0 THEN {hot} ELSE {recent} END)"


@query("gen_bids", f"""
    SELECT {_recent('event_id', 'event_id // 46 * 3', 21)} AS auction,
           {_recent('event_id', 'event_id // 46', 23)} AS bidder,
           100 + {_mixed('event_id', 25)} % 1000000 AS price,
           event_id * 1086 // 1000 AS "dateTime", '' AS extra
    FROM events""")
def gen_bids(spark, sf_dir):
    return generate.gen_bids(tables.events(spark, sf_dir), "event_id")


@query("gen_auctions", f"""
    SELECT 1000 + event_id AS id, 'item ' || event_id AS "itemName",
           'lot number ' || {_mixed('event_id', 12)} % 1000 AS description,
           100 + {_mixed('event_id', 11)} % 10000 AS "initialBid",
           100 + {_mixed('event_id', 11)} % 10000 + {_mixed('event_id', 13)} % 10000 AS reserve,
           event_id * 16666 // 1000 AS "dateTime",
           event_id * 16666 // 1000 + 1000 * (1 + {_mixed('event_id', 14)} % 100) AS expires,
           {_recent('event_id', 'event_id // 3', 15)} AS seller,
           10 + {_mixed('event_id', 17)} % 5 AS category, '' AS extra
    FROM events""")
def gen_auctions(spark, sf_dir):
    return generate.gen_auctions(tables.events(spark, sf_dir), "event_id")


@query("gen_persons", f"""
    SELECT 1000 + event_id AS id,
           {_pick(generate.FIRST_NAMES, _mixed('event_id', 1))} || ' ' ||
           {_pick(generate.LAST_NAMES, _mixed('event_id', 2))} AS name,
           'p' || event_id || '@example.org' AS "emailAddress",
           concat_ws(' ', {', '.join(f"lpad(CAST({_mixed('event_id', 4 + k)} % 10000 AS VARCHAR), 4, '0')" for k in range(4))})
               AS "creditCard",
           {_pick([c for c, _ in generate.PLACES], _mixed('event_id', 3))} AS city,
           {_pick([s for _, s in generate.PLACES], _mixed('event_id', 3))} AS state,
           event_id * 50000 // 1000 AS "dateTime", '' AS extra
    FROM events""")
def gen_persons(spark, sf_dir):
    return generate.gen_persons(tables.events(spark, sf_dir), "event_id")


@query("rate_schedule", """
    SELECT event_id, CAST(0 AS BIGINT) AS pos, event_id % 1000 AS rate, 1000 + event_id % 7 AS duration_ms FROM events
    UNION ALL
    SELECT event_id, 1, user_id, 5000 FROM events WHERE event_type <> 'click'""")
def rate_schedule(spark, sf_dir):
    # each event as a schedule text of two segments; clicks stop short of the second duration
    number = F.col("event_id")
    end = F.when(F.col("event_type") != "click", F.lit(5000))
    text = F.concat_ws("_", number % 1000, 1000 + number % 7, "user_id", end)
    texts = tables.events(spark, sf_dir).select("event_id", text.alias("schedule"))
    return generate.parse_schedule(texts, "schedule", ["event_id"])


@query("schedule_remaining", """
    WITH days AS (SELECT user_id, CAST(epoch(date_trunc('day', ts)) // 86400 AS BIGINT) AS pos, count(*) AS rate,
                         count(*) * 1000 AS duration_ms
                  FROM events GROUP BY 1, 2),
         ends AS (SELECT *, sum(duration_ms) OVER (PARTITION BY user_id ORDER BY pos) AS end_ms FROM days)
    SELECT user_id, pos, rate, CAST(least(duration_ms, end_ms - 20500) AS BIGINT) AS duration_ms
    FROM ends WHERE end_ms > 20500""")
def schedule_remaining(spark, sf_dir):
    # one segment per user and day, of as many seconds as the user has events on it
    day = F.floor(epoch_millis("ts") / 86_400_000).cast("long")
    days = tables.events(spark, sf_dir).groupBy("user_id", day.alias("pos")).agg(
        F.count("*").alias("rate"), (F.count("*") * 1000).alias("duration_ms")
    )
    return generate.schedule_remaining(days, 20_500, ["user_id"])


@query("sorted_results", "SELECT id, seller, category FROM auction ORDER BY seller, id", "auction")
def sorted_results(spark, sf_dir):
    return aggregates.sorted_rows(tables.auctions(spark, sf_dir).select("id", "seller", "category"), "seller", "id")


@query("bounded_collect", """
    SELECT auction, price, bidder, ts FROM ebid ORDER BY price DESC, bidder LIMIT 100""", "ebid")
def bounded_collect(spark, sf_dir):
    bids = tables.event_bids(spark, sf_dir).select("auction", "price", "bidder", "ts")
    return aggregates.first_rows(bids, 100, F.desc("price"), F.asc("bidder"))
