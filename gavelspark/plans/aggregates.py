"""Queries that aggregate: windows, hot items, highest bids, averages, record highs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import aggregates, joins, project, windows
from gavelspark.operators.scan import ALL_HOT
from gavelspark.plans.events import AS_OF
from gavelspark.plans.registry import query
from gavelspark.sources import tables

# Sliding windows of an hour that start every minute: the starts a row belongs to.
_STARTS = """unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 59 MINUTE,
                                    time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE))"""
COUNTS_SQL = f"""
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, auction, count(*) AS n
    FROM (SELECT auction, {_STARTS} AS window_start FROM ebid) GROUP BY ALL"""
HOT_SQL = f"""
    WITH counts AS ({COUNTS_SQL})
    SELECT * FROM counts QUALIFY n = max(n) OVER (PARTITION BY window_start)"""


def bucket(width: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL {width}, {ts}, TIMESTAMP '1970-01-01')"


@query("q5_bid_counts", COUNTS_SQL, "ebid")
def q5_bid_counts(spark, sf_dir):
    return aggregates.bid_counts(tables.event_bids(spark, sf_dir))


@query("q5_hot_items", HOT_SQL, "ebid")
def q5_hot_items(spark, sf_dir):
    return aggregates.hot_items(tables.event_bids(spark, sf_dir))


@query("hot_message", f"""
    SELECT 'Auction ' || auction || ' had the highest number of bids: ' || n || ' in the window ending '
           || epoch_ms(window_end) AS message FROM ({HOT_SQL})""", "ebid")
def hot_message(spark, sf_dir):
    return project.hot_item_messages(aggregates.hot_items(tables.event_bids(spark, sf_dir)))


@query("tuple_sink", f"SELECT '(' || auction || ',' || n || ')' AS value FROM ({COUNTS_SQL})", "ebid")
def tuple_sink(spark, sf_dir):
    return project.tuple_messages(aggregates.bid_counts(tables.event_bids(spark, sf_dir)))


def _tumbling(width: str) -> str:
    return f"""
    SELECT {bucket(width)} AS window_start, {bucket(width)} + INTERVAL {width} AS window_end,
           auction, count(*) AS n, max(price) AS top_price FROM ebid GROUP BY ALL"""


def _tumbling_plan(spark, sf_dir, width):
    aggs = [F.count("*").alias("n"), F.max("price").alias("top_price")]
    return windows.windowed(tables.event_bids(spark, sf_dir), aggs, width, keys=["auction"])


@query("window_10s", _tumbling("10 SECOND"), "ebid")
def window_10s(spark, sf_dir):
    return _tumbling_plan(spark, sf_dir, "10 seconds")


@query("window_1min", _tumbling("1 MINUTE"), "ebid")
def window_1min(spark, sf_dir):
    return _tumbling_plan(spark, sf_dir, "1 minute")


@query("window_10min", _tumbling("10 MINUTE"), "ebid")
def window_10min(spark, sf_dir):
    return _tumbling_plan(spark, sf_dir, "10 minutes")


@query("max_price_per_auction_category", """
    SELECT b.auction, a.expires, a.category, max(b.price) AS final
    FROM bid b JOIN auction a ON b.auction = a.id WHERE b.ts BETWEEN a.ts AND a.expires GROUP BY ALL""",
    "bid auction")
def max_price_per_auction_category(spark, sf_dir):
    return aggregates.final_prices(
        tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), ["category"], joins.IN_LIFETIME
    )


@query("max_price_per_auction_seller", """
    SELECT b.auction, a.expires, a.seller, max(b.price) AS final
    FROM bid b JOIN auction a ON b.auction = a.id WHERE b.ts < a.expires GROUP BY ALL""", "bid auction")
def max_price_per_auction_seller(spark, sf_dir):
    return aggregates.final_prices(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), ["seller"])


_JOINED = """SELECT b.auction, b.bidder, b.price, b.ts, a.{key}
             FROM bid b JOIN auction a ON b.auction = a.id WHERE b.ts < a.expires"""


def records_sql(key: str) -> str:
    return f"""
    SELECT {key}, ts, price, auction, bidder
    FROM (SELECT *, max(price) OVER (PARTITION BY {key} ORDER BY ts, price, auction, bidder
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
          FROM ({_JOINED.format(key=key)}))
    WHERE best IS NULL OR price > best"""


# Categories are few, so all of them are hot at any size worth the while: nothing to count.
# Ship dates are whole days: a chunk of an hour would hold one of them.
_DAYS = "30 days"
_BY_DAY = (("ts", _DAYS), ("price", 1 << 20), "auction", "bidder")


def _joined(spark, sf_dir, key):
    return joins.bid_auction_join(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), [key])


@query("record_highs_category", records_sql("category"), "bid auction")
def record_highs_category(spark, sf_dir):
    return aggregates.record_highs(_joined(spark, sf_dir, "category"), "category", chunk=_DAYS, hot_rows=ALL_HOT)


@query("record_highs_seller", records_sql("seller"), "bid auction")
def record_highs_seller(spark, sf_dir):
    return aggregates.record_highs(_joined(spark, sf_dir, "seller"), "seller", chunk=_DAYS)


def _running_sql(key: str) -> str:
    return f"""
    SELECT {key}, ts, price, auction, bidder, count(*) OVER w AS running_count,
           CAST(sum(price) OVER w AS DOUBLE) / count(*) OVER w AS running_avg
    FROM ({_JOINED.format(key=key)})
    WINDOW w AS (PARTITION BY {key} ORDER BY ts, price, auction, bidder
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("running_avg", _running_sql("category"), "bid auction")
def running_avg(spark, sf_dir):
    return aggregates.running_average(_joined(spark, sf_dir, "category"), "category", _BY_DAY, hot_rows=ALL_HOT)


@query("running_avg_by_expiry", """
    SELECT a.expires, b.ts, b.price, b.auction, b.bidder, count(*) OVER w AS running_count,
           CAST(sum(b.price) OVER w AS DOUBLE) / count(*) OVER w AS running_avg
    FROM bid b JOIN auction a ON b.auction = a.id WHERE b.ts < a.expires
    WINDOW w AS (PARTITION BY a.expires ORDER BY b.ts, b.price, b.auction, b.bidder
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "bid auction")
def running_avg_by_expiry(spark, sf_dir):
    joined = joins.bid_auction_join(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), [])
    return aggregates.running_average(joined, "expires", _BY_DAY)


def windowed_avg_sql(key: str, width: str) -> str:
    return f"""
    SELECT {bucket(width)} AS window_start, {bucket(width)} + INTERVAL {width} AS window_end, {key},
           count(*) AS n, CAST(sum(price) AS BIGINT) AS total, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price
    FROM ({records_sql(key)}) GROUP BY ALL"""


@query("q4_windowed_avg", windowed_avg_sql("category", "30 DAY"), "bid auction")
def q4_windowed_avg(spark, sf_dir):
    return aggregates.windowed_average(record_highs_category(spark, sf_dir), "category", "30 days")


@query("q6_windowed_avg", windowed_avg_sql("seller", "30 DAY"), "bid auction")
def q6_windowed_avg(spark, sf_dir):
    return aggregates.windowed_average(record_highs_seller(spark, sf_dir), "seller", "30 days")


def highest_per_auction_sql(width: str) -> str:
    return f"""
    SELECT {bucket(width)} AS window_start, {bucket(width)} + INTERVAL {width} AS window_end, auction, price, bidder
    FROM ebid
    QUALIFY row_number() OVER (PARTITION BY {bucket(width)}, auction ORDER BY price DESC, ts DESC, bidder DESC) = 1"""


@query("q7_highest_bid_per_auction", highest_per_auction_sql("10 MINUTE"), "ebid")
def q7_highest_bid_per_auction(spark, sf_dir):
    return aggregates.highest_bid_per_auction(tables.event_bids(spark, sf_dir), "10 minutes")


@query("q7_highest_bid_per_auction_1min", highest_per_auction_sql("1 MINUTE"), "ebid")
def q7_highest_bid_per_auction_1min(spark, sf_dir):
    return aggregates.highest_bid_per_auction(tables.event_bids(spark, sf_dir), "1 minute")


HIGHEST_SQL = f"""
    SELECT {bucket('10 MINUTE')} AS window_start, {bucket('10 MINUTE')} + INTERVAL 10 MINUTE AS window_end,
           auction, price, bidder
    FROM ebid QUALIFY price = max(price) OVER (PARTITION BY {bucket('10 MINUTE')})"""


@query("q7_highest_bid", HIGHEST_SQL, "ebid")
def q7_highest_bid(spark, sf_dir):
    return aggregates.highest_bids(tables.event_bids(spark, sf_dir), "10 minutes")


@query("max_semi_join", "SELECT * FROM bid QUALIFY price = max(price) OVER (PARTITION BY bidder)", "bid")
def max_semi_join(spark, sf_dir):
    return joins.at_group_max(tables.bids(spark, sf_dir), ["bidder"], "price")


@query("max_by_group", """
    SELECT auction, price, bidder FROM bid
    QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price DESC, bidder DESC) = 1""", "bid")
def max_by_group(spark, sf_dir):
    return aggregates.max_price_bid(tables.bids(spark, sf_dir))


def _category_sql(rule: str) -> str:
    return f"""
    SELECT category, count(*) AS auctions, CAST(sum(final) AS DOUBLE) / count(*) AS avg_price
    FROM (SELECT a.id, a.category, max(b.price) AS final FROM bid b JOIN auction a ON b.auction = a.id
          WHERE {rule} GROUP BY a.id, a.category) GROUP BY category"""


@query("q4_avg_price_by_category", _category_sql("b.ts BETWEEN a.ts AND a.expires"), "bid auction")
def q4_avg_price_by_category(spark, sf_dir):
    return aggregates.avg_price_by_category(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir))


@query("q4_avg_price_before_expiry", _category_sql("b.ts < a.expires"), "bid auction")
def q4_avg_price_before_expiry(spark, sf_dir):
    return aggregates.avg_price_by_category(
        tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), joins.BEFORE_EXPIRY
    )


@query("q6_avg_price_by_seller_last10", f"""
    SELECT auction, expires, seller, final, count(*) OVER w AS sales,
           CAST(sum(final) OVER w AS DOUBLE) / count(*) OVER w AS avg_final
    FROM (SELECT b.auction, a.expires, a.seller, max(b.price) AS final
          FROM bid b JOIN auction a ON b.auction = a.id
          WHERE b.ts < a.expires AND a.expires < TIMESTAMP '{AS_OF}' GROUP BY ALL)
    WINDOW w AS (PARTITION BY seller ORDER BY expires, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "bid auction")
def q6_avg_price_by_seller_last10(spark, sf_dir):
    return aggregates.avg_of_last_sales(tables.bids(spark, sf_dir), tables.auctions(spark, sf_dir), AS_OF)


@query("late_flags", f"""
    SELECT seq, auction, price, ts, arrival,
           coalesce({bucket('10 MINUTE')} + INTERVAL 10 MINUTE
               <= max(ts) OVER (ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  - INTERVAL 20 SECOND, false) AS is_late
    FROM (SELECT *, ts + to_seconds((seq * 7919) % 7200) AS arrival FROM ebid)""", "ebid")
def late_flags(spark, sf_dir):
    bids = tables.event_bids(spark, sf_dir).select(
        "seq", "auction", "price", "ts",
        (F.col("ts") + F.make_dt_interval(secs=((F.col("seq") * 7919) % 7200).cast("decimal(18,6)"))).alias("arrival"),
    )
    return windows.late_flags(bids, [("arrival", "1 minute"), ("seq", 1 << 16)], "10 minutes", "20 seconds")
