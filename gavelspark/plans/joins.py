"""Queries that join bids, auctions and persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import asof, joins
from gavelspark.plans.registry import query
from gavelspark.sources import tables

_LOCAL = "p.state IN ('OR', 'ID', 'CA')"


@query("q3_local_items", f"""
    SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id
    WHERE {_LOCAL} AND a.category = 10""", "auction person")
def q3_local_items(spark, sf_dir):
    return joins.local_items(tables.auctions(spark, sf_dir), tables.persons(spark, sf_dir))


@query("q3_no_category", f"""
    SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id
    WHERE {_LOCAL}""", "auction person")
def q3_no_category(spark, sf_dir):
    return joins.local_items(tables.auctions(spark, sf_dir), tables.persons(spark, sf_dir), category=None)


PENDING_SQL = """
    WITH pp AS (SELECT * FROM member WHERE state IN ('OR', 'ID', 'CA')),
    firsts AS (SELECT id, min_by(name, seq) AS name, min_by(city, seq) AS city, min_by(state, seq) AS state,
                      min(seq) AS seq FROM pp GROUP BY id),
    hit AS (SELECT a.id, q.name, q.city, q.state,
                   row_number() OVER (PARTITION BY a.seq ORDER BY q.seq DESC) AS r
            FROM item a JOIN pp q ON q.id = a.seller AND q.seq < a.seq),
    wait AS (SELECT DISTINCT a.id, f.name, f.city, f.state
             FROM item a JOIN firsts f ON f.id = a.seller AND a.seq < f.seq)
    SELECT name, city, state, id FROM hit WHERE r = 1
    UNION ALL SELECT name, city, state, id FROM wait"""


@query("q3_pending_join", PENDING_SQL, "item member")
def q3_pending_join(spark, sf_dir):
    return asof.pending_join(tables.event_items(spark, sf_dir), tables.event_persons(spark, sf_dir))


def latest_sql(prefilter: bool) -> str:
    return f"""
    WITH u AS (SELECT seller AS k, seq, 'A' AS tag, id AS aid, category, NULL::VARCHAR AS name,
                      NULL::VARCHAR AS city, NULL::VARCHAR AS state FROM item
               UNION ALL
               SELECT id, seq, 'P', NULL, NULL, name, city, state FROM member p
               {f'WHERE {_LOCAL}' if prefilter else ''}),
    w AS (SELECT last_value(CASE WHEN tag = 'A' THEN {{'id': aid, 'cat': category}} END IGNORE NULLS) OVER x AS la,
                 last_value(CASE WHEN tag = 'P' THEN {{'name': name, 'city': city, 'state': state}} END IGNORE NULLS)
                     OVER x AS lp
          FROM u WINDOW x AS (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT lp.name AS name, lp.city AS city, lp.state AS state, la.id AS id FROM w
    WHERE la IS NOT NULL AND lp IS NOT NULL AND la.cat = 10 AND lp.state IN ('OR', 'ID', 'CA')"""


@query("q3_latest_join", latest_sql(False), "item member")
def q3_latest_join(spark, sf_dir):
    return asof.latest_join(tables.event_items(spark, sf_dir), tables.event_persons(spark, sf_dir))


@query("q3_latest_join_prefiltered", latest_sql(True), "item member")
def q3_latest_join_prefiltered(spark, sf_dir):
    return asof.latest_join(tables.event_items(spark, sf_dir), tables.event_persons(spark, sf_dir), prefilter=True)


@query("bid_auction_join", """
    SELECT b.auction, b.price, a.expires, a.category FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts < a.expires""", "bid auction")
def bid_auction_join(spark, sf_dir):
    joined = joins.bid_auction_join(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir))
    return joined.select("auction", "price", "expires", "category")


@query("bid_auction_seller_join", """
    SELECT b.auction, b.price, a.expires, a.seller FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts < a.expires""", "bid auction")
def bid_auction_seller_join(spark, sf_dir):
    joined = joins.bid_auction_join(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), ["seller"])
    return joined.select("auction", "price", "expires", "seller")


@query("bid_auction_join_lifetime", """
    SELECT b.auction, b.price, a.expires, a.category FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts BETWEEN a.ts AND a.expires""", "bid auction")
def bid_auction_join_lifetime(spark, sf_dir):
    joined = joins.bid_auction_join(
        tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), rule=joins.IN_LIFETIME
    )
    return joined.select("auction", "price", "expires", "category")


@query("expired_bid_flush", """
    SELECT b.auction, b.price, b.bidder, a.expires, a.category FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts >= a.expires""", "bid auction")
def expired_bid_flush(spark, sf_dir):
    rejected = joins.rejected_bids(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir))
    return rejected.select("auction", "price", "bidder", "expires", "category")


# Arrival numbers: event ids out of order by up to 997. A sign-up is also a bid, and its
# auction goes in half a step before it.
_ARRIVAL = "(1000 * ({0} + ({0} * 7919) % 997) + {0} % 1000)"


def buffered_sql(watermark: str) -> str:
    return f"""
    WITH b AS (SELECT auction, price, ts, 2 * {_ARRIVAL.format('seq')} AS seq FROM ebid),
    a AS (SELECT id, seller, expires, 2 * {_ARRIVAL.format('seq')} - 1 AS seq FROM eauction),
    w AS (SELECT *, {watermark} AS watermark FROM b)
    SELECT a.id AS auction, w.price, a.expires, a.seller FROM w JOIN a ON w.auction = a.id
    WHERE w.seq < a.seq OR (a.expires > w.ts AND (w.watermark IS NULL OR a.expires > w.watermark))"""


def _arriving_bids(spark, sf_dir):
    seq = f"2 * {_ARRIVAL.format('seq')} AS seq"
    return tables.event_bids(spark, sf_dir).selectExpr("auction", seq, "bidder", "price", "ts")


def _arriving_auctions(spark, sf_dir):
    seq = f"2 * {_ARRIVAL.format('seq')} - 1 AS seq"
    return tables.event_auctions(spark, sf_dir).selectExpr("id", seq, "seller", "ts", "expires")


@query("bid_auction_buffered", buffered_sql("NULL::TIMESTAMP"), "ebid eauction")
def bid_auction_buffered(spark, sf_dir):
    return asof.buffered_join(_arriving_bids(spark, sf_dir), _arriving_auctions(spark, sf_dir))


@query("bid_auction_buffered_watermark", buffered_sql(
    "max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR"
), "ebid eauction")
def bid_auction_buffered_watermark(spark, sf_dir):
    timed = asof.with_arrival_watermark(_arriving_bids(spark, sf_dir), "1 hour")
    return asof.buffered_join(timed, _arriving_auctions(spark, sf_dir))


VERSIONS_SQL = """
    WITH b AS (SELECT auction, price, ts, 2 * seq AS seq FROM ebid),
    was AS (SELECT b.*, v.expires AS was_expires, v.seller AS was_seller
            FROM b ASOF LEFT JOIN version v ON b.auction = v.id AND b.seq >= v.seq),
    both_ AS (SELECT was.*, v.expires AS next_expires, v.seller AS next_seller
              FROM was ASOF LEFT JOIN version v ON was.auction = v.id AND was.seq <= v.seq)
    SELECT auction, price,
           CASE WHEN was_expires > ts THEN was_expires ELSE next_expires END AS expires,
           CASE WHEN was_expires > ts THEN was_seller ELSE next_seller END AS seller
    FROM both_ WHERE coalesce(was_expires > ts, false) OR next_expires IS NOT NULL"""


@query("bid_auction_buffered_versions", VERSIONS_SQL, "ebid version")
def bid_auction_buffered_versions(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    bids = tables.event_bids_from(events).withColumn("seq", 2 * F.col("seq"))
    return asof.buffered_join(bids, tables.event_versions_from(events))


def new_sellers_sql(persons: str, auctions: str, width: str) -> str:
    bucket = f"time_bucket(INTERVAL {width}, {{}}.ts, TIMESTAMP '1970-01-01')"
    return f"""
    SELECT {bucket.format('p')} AS window_start, {bucket.format('p')} + INTERVAL {width} AS window_end,
           p.id, p.name, a.reserve
    FROM {persons} p JOIN {auctions} a ON p.id = a.seller AND {bucket.format('p')} = {bucket.format('a')}"""


@query("q8_new_sellers", new_sellers_sql("member", "item", "1 DAY"), "member item")
def q8_new_sellers(spark, sf_dir):
    return joins.new_sellers(tables.event_persons(spark, sf_dir), tables.event_items(spark, sf_dir), "1 day")


@query("q8_hourly_sellers", new_sellers_sql("member", "item", "1 HOUR"), "member item")
def q8_hourly_sellers(spark, sf_dir):
    return joins.new_sellers(tables.event_persons(spark, sf_dir), tables.event_items(spark, sf_dir), "1 hour")


@query("q8_monthly_sellers", new_sellers_sql("person", "auction", "30 DAY"), "person auction")
def q8_monthly_sellers(spark, sf_dir):
    return joins.new_sellers(tables.persons(spark, sf_dir), tables.auctions(spark, sf_dir), "30 days")


@query("q8_range_join", """
    SELECT p.id, p.name, a.reserve, p.ts AS registered, a.ts AS opened
    FROM member p JOIN item a ON p.id = a.seller
    WHERE abs(epoch_us(p.ts) - epoch_us(a.ts)) < 3600000000""", "member item")
def q8_range_join(spark, sf_dir):
    return joins.sellers_within(tables.event_persons(spark, sf_dir), tables.event_items(spark, sf_dir), "1 hour")
