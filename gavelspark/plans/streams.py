"""Queries run as streams over the tables' files, up to what is there now.

What merges (counts, sums, maxima, records) is aggregated per micro-batch and merged when read: it
does not depend on how a table is cut into files and micro-batches. What depends on the order of
arrival carries a small table from one micro-batch to the next. Within a micro-batch (64 GiB of
files) its files may have any order; from one to the next they have to be written in the order of
arrival, or the query fails. Windows count once they are over: the SQL of windowed queries is limited
to windows that end by the latest event time less the delay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import aggregates, joins, project, windows
from gavelspark.plans import aggregates as batch
from gavelspark.plans.joins import PENDING_SQL, VERSIONS_SQL, latest_sql, new_sellers_sql
from gavelspark.plans.registry import query
from gavelspark.sources import tables
from gavelspark.streaming import carried, stateful
from gavelspark.streaming.run import run_available, run_joined, run_partials

DELAY = "20 seconds"
SALTS = 4  # parts of a join key: streams have no skew join


def _closed(sql: str) -> str:
    return f"""SELECT * FROM ({sql}) AS r
    WHERE r.window_end <= (SELECT max(ts) FROM events) - INTERVAL 20 SECOND"""


_stream = tables.stream_table


def _event_bids(spark, sf_dir):
    return tables.event_bids_from(_stream(spark, sf_dir, "events"))


def _latest(ts="ts"):
    """The latest event time of a micro-batch."""
    return lambda rows: rows.agg(F.max(ts).alias("ts"))


def _over(result, parts):
    """The windows that end by the latest event time less the delay."""
    return windows.closed_windows(result, parts["latest"], DELAY)


def _zone_free(df):
    times = [name for name, kind in df.dtypes if kind == "timestamp"]
    for name in times:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def _results(stream, label):
    return _zone_free(run_available(stream, label))


@query("stream_q1_currency", """
    SELECT auction, CAST(trunc(CAST(0.82 AS FLOAT) * CAST(price AS FLOAT)) AS BIGINT) AS price, bidder, ts
    FROM bid""", "bid")
def stream_q1_currency(spark, sf_dir):
    bids = tables.bids_from(_stream(spark, sf_dir, "lineitem"))
    return _results(project.currency_conversion(bids), "q1")


@query("stream_q3_local_items", """
    SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id
    WHERE p.state IN ('OR', 'ID', 'CA') AND a.category = 10""", "auction person")
def stream_q3_local_items(spark, sf_dir):
    nation = tables.read_table(spark, sf_dir, "nation")
    persons = tables.persons_from(_stream(spark, sf_dir, "customer"), nation)
    auctions = tables.auctions_from(_stream(spark, sf_dir, "orders"))
    return _zone_free(run_joined(auctions, persons, lambda a, p: joins.local_items(a, p, salts=SALTS), "q3"))


@query("stream_bid_auction_join", """
    SELECT b.auction, b.price, a.expires, a.category FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts < a.expires""", "bid auction")
def stream_bid_auction_join(spark, sf_dir):
    bids = tables.bids_from(_stream(spark, sf_dir, "lineitem"))
    auctions = tables.auctions_from(_stream(spark, sf_dir, "orders"))
    joined = lambda b, a: joins.bid_auction_join(b, a, salts=SALTS).select("auction", "price", "expires", "category")
    return _zone_free(run_joined(bids, auctions, joined, "bid-auction"))


_PANE = "1 minute"


def _panes(rows):
    return rows.groupBy(F.window("ts", _PANE)["start"].alias("ts"), "auction").agg(F.count("*").alias("n"))


def _counts(spark, sf_dir, label):
    parts = run_partials(_event_bids(spark, sf_dir), {"panes": _panes, "latest": _latest()}, label)
    return _over(windows.sliding_counts(parts["panes"], ["auction"], "60 minutes", _PANE, weight="n"), parts)


@query("stream_q5_bid_counts", _closed(batch.COUNTS_SQL), "ebid")
def stream_q5_bid_counts(spark, sf_dir):
    return _counts(spark, sf_dir, "q5-counts")


@query("stream_q5_hot_items", _closed(batch.HOT_SQL), "ebid")
def stream_q5_hot_items(spark, sf_dir):
    return joins.at_group_max(_counts(spark, sf_dir, "q5-hot"), windows.WINDOW_COLUMNS, "n")


@query("stream_q7_highest_bid_per_auction", _closed(batch.highest_per_auction_sql("10 MINUTE")), "ebid")
def stream_q7_highest_bid_per_auction(spark, sf_dir):
    # the best row of a window stays a row with its time: the best of those is the best of all
    best = lambda rows: rows.groupBy(F.window("ts", "10 minutes"), "auction").agg(
        F.max(F.struct("price", "ts", "bidder")).alias("top")
    ).select("auction", "top.*")
    parts = run_partials(_event_bids(spark, sf_dir), {"best": best, "latest": _latest()}, "q7-auction")
    return _over(aggregates.highest_bid_per_auction(parts["best"], "10 minutes"), parts)


@query("stream_q7_highest_bid", _closed(batch.HIGHEST_SQL), "ebid")
def stream_q7_highest_bid(spark, sf_dir):
    parts = run_partials(
        _event_bids(spark, sf_dir), {"best": lambda rows: aggregates.highest_bids(rows, "10 minutes"), "latest": _latest()}, "q7"
    )
    return _over(joins.at_group_max(parts["best"], windows.WINDOW_COLUMNS, "price"), parts)


@query("stream_q8_new_sellers", new_sellers_sql("member", "item", "1 DAY"), "member item")
def stream_q8_new_sellers(spark, sf_dir):
    parts = run_partials(
        _stream(spark, sf_dir, "events"), {"persons": tables.event_persons_from, "items": tables.event_items_from}, "q8"
    )
    return joins.new_sellers(parts["persons"], parts["items"], "1 day")


_SEQ_RECORDS = """
    SELECT auction, seq, price, bidder
    FROM (SELECT *, max(price) OVER (PARTITION BY auction ORDER BY seq
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ebid)
    WHERE best IS NULL OR price > best"""


@query("record_highs_by_arrival", _SEQ_RECORDS, "ebid")
def record_highs_by_arrival(spark, sf_dir):
    bids = tables.event_bids(spark, sf_dir)
    return aggregates.record_highs(bids, "auction", "seq", 1 << 20, ["bidder"])


@query("stream_record_highs", _SEQ_RECORDS, "ebid")
def stream_record_highs(spark, sf_dir):
    bids = _event_bids(spark, sf_dir).select("auction", "seq", "price", "bidder")
    return carried.record_highs(bids, "auction", "records")


@query("stream_record_highs_by_batch", _SEQ_RECORDS, "ebid")
def stream_record_highs_by_batch(spark, sf_dir):
    # a record of all rows is a record of its micro-batch: the batch operator, with its care
    # for hot keys, runs on each of them and once more on what they leave
    bids = _event_bids(spark, sf_dir).select("auction", "seq", "price", "bidder")
    highs = lambda rows: aggregates.record_highs(rows, "auction", "seq", 1 << 20, ["bidder"])
    return highs(run_partials(bids, {"highs": highs}, "record-parts")["highs"])


_SEQ_RUNNING = """
    SELECT auction, seq, price, count(*) OVER w AS running_count,
           CAST(sum(price) OVER w AS DOUBLE) / count(*) OVER w AS running_avg
    FROM ebid WINDOW w AS (PARTITION BY auction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("running_avg_by_arrival", _SEQ_RUNNING, "ebid")
def running_avg_by_arrival(spark, sf_dir):
    return aggregates.running_average(tables.event_bids(spark, sf_dir), "auction", [("seq", 1 << 20)])


@query("stream_running_avg", _SEQ_RUNNING, "ebid")
def stream_running_avg(spark, sf_dir):
    bids = _event_bids(spark, sf_dir).select("auction", "seq", "price")
    return carried.running_average(bids, "auction", "running")


def _items_and_people(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    return tables.event_items_from(events), tables.event_persons_from(events)


@query("stream_q3_pending_join", PENDING_SQL, "item member")
def stream_q3_pending_join(spark, sf_dir):
    return carried.pending_join(*_items_and_people(spark, sf_dir), "pending")


@query("stream_q3_latest_join", latest_sql(False), "item member")
def stream_q3_latest_join(spark, sf_dir):
    return carried.latest_join(*_items_and_people(spark, sf_dir), "latest")


@query("stream_q3_latest_join_prefiltered", latest_sql(True), "item member")
def stream_q3_latest_join_prefiltered(spark, sf_dir):
    return carried.latest_join(*_items_and_people(spark, sf_dir), "latest-prefiltered", prefilter=True)


@query("stream_bid_auction_buffered", VERSIONS_SQL, "ebid version")
def stream_bid_auction_buffered(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    bids = tables.event_bids_from(events).withColumn("seq", 2 * F.col("seq"))
    return carried.buffered_join(bids, tables.event_versions_from(events), "buffered")


# Auctions whose end the watermark has passed when the stream has read everything.
@query("stream_expired_bid_flush", """
    SELECT b.auction, b.price, b.bidder, b.ts, a.expires, a.category, b.ts < a.expires AS accepted
    FROM ubid b JOIN cauction a ON b.auction = a.id
    WHERE b.ts < a.expires OR a.expires <= (SELECT max(ts) FROM events) - INTERVAL 20 SECOND""", "ubid cauction")
def stream_expired_bid_flush(spark, sf_dir):
    bids = tables.user_bids_from(_stream(spark, sf_dir, "events"))
    auctions = tables.customer_auctions_from(_stream(spark, sf_dir, "customer"))
    return _results(stateful.expiry_timer_stream(bids, auctions, DELAY, hold="365 days"), "expiry")


@query("stream_windowed_avg", _closed(f"""
    SELECT {batch.bucket('1 DAY')} AS window_start, {batch.bucket('1 DAY')} + INTERVAL 1 DAY AS window_end, auction,
           count(*) AS n, CAST(sum(price) AS BIGINT) AS total, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price
    FROM (SELECT *, max(price) OVER (PARTITION BY auction ORDER BY seq
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ebid)
    WHERE best IS NULL OR price > best GROUP BY ALL"""), "ebid")
def stream_windowed_avg(spark, sf_dir):
    return _windowed_avg(spark, sf_dir, "auction")


def _windowed_avg(spark, sf_dir, key):
    highs = lambda rows: aggregates.record_highs(rows, key, "seq", 1 << 20, ["ts"])
    parts = run_partials(_event_bids(spark, sf_dir), {"highs": highs, "latest": _latest()}, "windowed-average")
    return _over(aggregates.windowed_average(highs(parts["highs"]), key, "1 day"), parts)


@query("stream_q4_avg_price_by_category", """
    SELECT category, count(*) AS auctions, CAST(sum(final) AS DOUBLE) / count(*) AS avg_price
    FROM (SELECT a.id, a.category, max(b.price) AS final FROM bid b JOIN auction a ON b.auction = a.id
          WHERE b.ts BETWEEN a.ts AND a.expires GROUP BY a.id, a.category) GROUP BY category""", "bid auction")
def stream_q4_avg_price_by_category(spark, sf_dir):
    finals = _final_prices(spark, sf_dir, "category", joins.IN_LIFETIME, "q4")["finals"]
    return aggregates.average_price(finals, "category")


def _final_prices(spark, sf_dir, key, rule, label):
    """Highest valid bid per auction: bids stream past the table of auctions, and only maxima are kept."""
    auctions = tables.auctions(spark, sf_dir)
    best = lambda rows: aggregates.final_prices(rows, auctions, [key], rule)
    bids = tables.bids_from(_stream(spark, sf_dir, "lineitem"))
    parts = run_partials(bids, {"finals": best, "latest": _latest()}, label)
    merged = parts["finals"].groupBy("auction", "expires", key).agg(F.max("final").alias("final"))
    return parts | {"finals": merged}


@query("stream_q6_last10", """
    SELECT auction, expires, seller, final, count(*) OVER w AS sales,
           CAST(sum(final) OVER w AS DOUBLE) / count(*) OVER w AS avg_final
    FROM (SELECT b.auction, a.expires, a.seller, max(b.price) AS final
          FROM bid b JOIN auction a ON b.auction = a.id
          WHERE b.ts < a.expires
            AND a.expires <= least((SELECT max(ts) FROM bid), (SELECT max(expires) FROM auction)) - INTERVAL 12 HOUR
          GROUP BY ALL)
    WINDOW w AS (PARTITION BY seller ORDER BY expires, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "bid auction")
def stream_q6_last10(spark, sf_dir):
    parts = _final_prices(spark, sf_dir, "seller", joins.BEFORE_EXPIRY, "last-sales")
    # an auction is over once both inputs have passed its end
    ends = tables.auctions(spark, sf_dir).agg(F.max("expires").alias("ts"))
    passed = parts["latest"].agg(F.max("ts").alias("ts")).union(ends).agg(F.min("ts") - F.expr("interval 12 hours"))
    finals = parts["finals"].filter(F.col("expires") <= passed.scalar())
    return aggregates.moving_average(finals, "seller", (("expires", "1 day"), ("auction", 1 << 20)), "final", 10)


@query("stream_max_price_per_auction", """
    SELECT b.auction, a.expires, a.seller, max(b.price) AS final
    FROM bid b JOIN auction a ON b.auction = a.id WHERE b.ts < a.expires GROUP BY ALL""", "bid auction")
def stream_max_price_per_auction(spark, sf_dir):
    return _final_prices(spark, sf_dir, "seller", joins.BEFORE_EXPIRY, "final-prices")["finals"]


def _sellers_bids(spark, sf_dir):
    """Bids streamed past the table of auctions, with the seller; ``seq`` is the day of the bid."""
    auctions = tables.auctions(spark, sf_dir)
    bids = tables.bids_from(_stream(spark, sf_dir, "lineitem"))
    return bids, lambda rows: joins.bid_auction_join(rows, auctions, ["seller"])


@query("stream_bid_auction_seller_join", """
    SELECT b.auction, b.bidder, b.price, b.ts, a.seller, a.expires FROM bid b JOIN auction a ON b.auction = a.id
    WHERE b.ts < a.expires""", "bid auction")
def stream_bid_auction_seller_join(spark, sf_dir):
    bids, joined = _sellers_bids(spark, sf_dir)
    columns = ("auction", "bidder", "price", "ts", "seller", "expires")
    return run_partials(bids, {"joined": lambda rows: joined(rows).select(*columns)}, "seller-join")["joined"]


@query("stream_record_highs_seller", batch.records_sql("seller"), "bid auction")
def stream_record_highs_seller(spark, sf_dir):
    bids, joined = _sellers_bids(spark, sf_dir)
    highs = lambda rows: aggregates.record_highs(rows, "seller", chunk="30 days")
    return highs(run_partials(bids, {"highs": lambda rows: highs(joined(rows))}, "seller-records")["highs"])


@query("stream_q6_windowed_avg", batch.windowed_avg_sql("seller", "30 DAY"), "bid auction")
def stream_q6_windowed_avg(spark, sf_dir):
    return aggregates.windowed_average(stream_record_highs_seller(spark, sf_dir), "seller", "30 days")


@query("stream_throughput", """
    SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def stream_throughput(spark, sf_dir):
    counts = lambda rows: rows.groupBy(F.window("ts", "1 minute")["start"].alias("window_start")).agg(F.count("*").alias("n"))
    parts = run_partials(_stream(spark, sf_dir, "events"), {"counts": counts}, "throughput")["counts"]
    return parts.groupBy("window_start").agg(F.sum("n").alias("n"))
