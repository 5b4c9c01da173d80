"""Queries on a live topic of events, in several micro-batches under a watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.operators import asof, joins, telemetry, windows
from gavelspark.plans import aggregates as batch
from gavelspark.plans.joins import new_sellers_sql
from gavelspark.plans.registry import query
from gavelspark.schema import epoch_millis
from gavelspark.session import shared_folder
from gavelspark.sources import codec, replay, tables, topic
from gavelspark.sources.replay import OUT_OF_ORDER_SQL, arrived_sql, watermarks_sql
from gavelspark.streaming import live
from gavelspark.streaming.run import LATENCY_METRICS, each_kept, kept_state, observed_delay, run_live, run_through, zone_free
from gavelspark.streaming.windows import hot_items_stream

PERSON_DELAY, ITEM_DELAY = "10 minutes", "2 hours"


@query("stream_q8_closed_windows", f"""
    SELECT * FROM ({new_sellers_sql("member", "item", "1 DAY")}) AS r
    WHERE r.window_end <= least((SELECT max(ts) FROM member) - INTERVAL 10 MINUTE, (SELECT max(ts) FROM item) - INTERVAL 2 HOUR)""",
    "member item")
def stream_q8_closed_windows(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "q8-topic")
    persons = windows.with_watermark(tables.event_persons_from(sent.stream()), PERSON_DELAY)
    items = windows.with_watermark(tables.event_items_from(sent.stream()), ITEM_DELAY)
    return zone_free(run_live(live.closed_new_sellers(persons, items, "1 day", salts=2), "q8-closed")[0])


HOT_DELAY = "10 minutes"


@query("stream_q5_hot_items_closed", f"""
    SELECT * FROM ({batch.HOT_SQL}) AS r WHERE r.window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", "ebid")
def stream_q5_hot_items_closed(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "q5-topic")
    bids = windows.with_watermark(tables.event_bids_from(sent.stream()), HOT_DELAY)
    return zone_free(run_live(hot_items_stream(bids), "q5-closed")[0])


LATE_SIZE, LATE_DELAY = "10 minutes", "5 minutes"
_LATE_MS = 5 * 60_000


@query("stream_late_rows", f"""
    WITH {arrived_sql(OUT_OF_ORDER_SQL)}, {watermarks_sql(_LATE_MS)}
    SELECT event_id AS seq, ts, epoch_ms({batch.bucket("10 MINUTE")} + INTERVAL 10 MINUTE) <= wm AS is_late, wm AS watermark_ms
    FROM arrived JOIN watermarks USING (batch)""")
def stream_late_rows(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "late-topic", replay.out_of_order())
    events = sent.stream().select(F.col("event_id").alias("seq"), "ts")
    return zone_free(run_live(live.late_rows(events, LATE_SIZE, LATE_DELAY), "late")[0])


@query("stream_on_time_counts", f"""
    WITH {arrived_sql(OUT_OF_ORDER_SQL)}, {watermarks_sql(_LATE_MS)},
    kept AS (SELECT {batch.bucket("10 MINUTE")} AS window_start, epoch_ms({batch.bucket("10 MINUTE")} + INTERVAL 10 MINUTE) <= wm AS is_late
             FROM arrived JOIN watermarks USING (batch))
    SELECT window_start, count(*) FILTER (NOT is_late) AS on_time, count(*) FILTER (is_late) AS late FROM kept GROUP BY window_start""")
def stream_on_time_counts(spark, sf_dir):
    # two outputs of one run, brought together by window
    sent = replay.replay(spark, sf_dir, "late-topic", replay.out_of_order())
    marked = zone_free(run_live(live.late_rows(sent.stream().select("event_id", "ts"), LATE_SIZE, LATE_DELAY), "on-time")[0])
    on_time, late = live.on_time_and_late(marked)
    counted = lambda rows, name: windows.windowed(rows, [F.count("*").alias(name)], LATE_SIZE).drop("window_end")
    both = counted(on_time, "on_time").join(counted(late, "late"), "window_start", "full")
    return both.select("window_start", F.coalesce("on_time", F.lit(0)).alias("on_time"), F.coalesce("late", F.lit(0)).alias("late"))


# Spark's own late filter goes by the watermark of the micro-batch before.
@query("stream_late_dropped", f"""
    WITH {arrived_sql(OUT_OF_ORDER_SQL)}, {watermarks_sql(_LATE_MS)},
    met AS (SELECT epoch_us(ts) <= 1000 * coalesce(before, 0) AS dropped
            FROM arrived JOIN (SELECT batch, lag(wm) OVER (ORDER BY batch) AS before FROM watermarks) USING (batch))
    SELECT count(*) AS input_rows, count(*) FILTER (dropped) AS dropped_rows, count(*) FILTER (NOT dropped) AS kept_rows FROM met""")
def stream_late_dropped(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "dropped-topic", replay.out_of_order())
    timed = windows.with_watermark(sent.stream().select("event_id", "ts"), LATE_DELAY)
    kept, reports = run_live(timed.dropDuplicates(["event_id", "ts"]), "dropped")
    told = telemetry.progress_table(reports).select("input_rows", F.col("late_rows").alias("dropped_rows"))
    return told.withColumn("kept_rows", kept.agg(F.count("*")).scalar())


@query("stream_q6_last10_closed", """
    SELECT auction, expires, seller, final, count(*) OVER w AS sales, CAST(sum(final) OVER w AS DOUBLE) / count(*) OVER w AS avg_final
    FROM (SELECT b.auction, a.expires, a.id % 5 AS seller, max(b.price) AS final FROM ubid b JOIN cauction a ON b.auction = a.id
          WHERE b.ts < a.expires AND a.expires <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL)
    WINDOW w AS (PARTITION BY seller ORDER BY expires, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "ubid cauction")
def stream_q6_last10_closed(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "q6-topic")
    auctions = tables.customer_auctions_from(tables.stream_table(spark, sf_dir, "customer")).withColumn("seller", F.pmod("id", F.lit(5)))
    return zone_free(run_live(live.last_sales(tables.user_bids_from(sent.stream()), auctions, HOT_DELAY), "q6-closed")[0])


@query("stream_bid_auction_buffered_watermark", f"""
    WITH {arrived_sql(OUT_OF_ORDER_SQL)}, {watermarks_sql(3 * 3_600_000)},
    b AS (SELECT user_id % 20 AS auction, CAST(round(value * 100) AS BIGINT) AS price, ts, 2 * arrival AS seq, wm FROM arrived JOIN watermarks USING (batch)),
    version AS (SELECT user_id % 20 AS id, 2 * arrival - 1 AS seq, user_id AS seller, ts + INTERVAL 6 HOUR AS expires FROM arrived WHERE event_type = 'signup'),
    was AS (SELECT b.*, v.expires AS was_expires, v.seller AS was_seller FROM b ASOF LEFT JOIN version v ON b.auction = v.id AND b.seq >= v.seq),
    both_ AS (SELECT was.*, v.expires AS next_expires, v.seller AS next_seller FROM was ASOF LEFT JOIN version v ON was.auction = v.id AND was.seq <= v.seq),
    told AS (SELECT *, coalesce(was_expires > ts AND epoch_us(was_expires) > 1000 * wm, false) AS live FROM both_)
    SELECT auction, price, CASE WHEN live THEN was_expires ELSE next_expires END AS expires, CASE WHEN live THEN was_seller ELSE next_seller END AS seller
    FROM told WHERE live OR next_expires IS NOT NULL""")
def stream_bid_auction_buffered_watermark(spark, sf_dir):
    events = replay.replay(spark, sf_dir, "buffered-topic", replay.out_of_order()).stream()
    none = lambda kind: F.lit(None).cast(kind)
    auction, signup = F.col("user_id") % 20, F.col("event_type") == "signup"
    bid = F.struct((2 * F.col("arrival")).alias("seq"), auction.alias("auction"), tables.minor_units("value").alias("price"), none("long").alias("id"), none("timestamp").alias("expires"), none("long").alias("seller"))
    version = F.struct(
        (2 * F.col("arrival") - 1).alias("seq"), none("long").alias("auction"), none("long").alias("price"), auction.alias("id"),
        (F.col("ts") + F.expr("interval 6 hours")).alias("expires"), F.col("user_id").alias("seller"),
    )
    both = events.select("ts", F.explode(F.when(signup, F.array(version, bid)).otherwise(F.array(bid))).alias("one")).select("ts", "one.*")
    return zone_free(run_live(live.buffered_join(both, "3 hours"), "buffered-live")[0])


@query("topic_offsets", f"""
    WITH {arrived_sql(OUT_OF_ORDER_SQL)}
    SELECT event_id, user_id, event_type, value, props, arrival, ts, CAST(part AS INTEGER) AS "partition", pos AS "offset" FROM arrived""")
def topic_offsets(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "topic", replay.out_of_order())
    return zone_free(run_live(sent.stream(), "topic-read")[0])


# A group commits a micro-batch when the next one begins: of what it read first, the last one comes again.
@query("topic_restart", f"""
    WITH {arrived_sql()}, half AS (SELECT max(event_id) // 2 AS last FROM events),
    firsts AS (SELECT part, count(*) AS n FROM arrived, half WHERE event_id <= last GROUP BY part),
    runs AS (SELECT 'first' AS run, part, pos FROM arrived, half WHERE event_id <= last
             UNION ALL SELECT 'goes on', part, pos FROM arrived, half WHERE event_id > last
             UNION ALL SELECT 'earliest', part, pos FROM arrived
             UNION ALL SELECT 'committed', part, pos FROM arrived JOIN firsts USING (part)
                       WHERE pos >= least(n, per_batch * (((SELECT max(n) FROM firsts) - 1) // per_batch)))
    SELECT run, CAST(part AS INTEGER) AS "partition", min(pos) AS first_offset, max(pos) AS last_offset, count(*) AS messages FROM runs GROUP BY run, part""")
def topic_restart(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    last, n = events.agg(F.floor(F.max("event_id") / 2), F.count("*")).first()
    path, partitions, limit = shared_folder(spark, "restart"), replay.partitions_of(n), replay.per_batch_of(n)
    folder = shared_folder(spark, "restart-run")

    def read(run, state, group, starting):
        """What was read on the checkpoint ``state``, once this run has come to the end of the topic."""
        records = topic.stream(spark, path, group, starting, limit, state).select(F.lit(run).alias("run"), "partition", "offset")
        return run_live(records, run, f"{folder}/{state}")[0]

    replay.sent(events.filter(F.col("event_id") <= last), path, replay.in_order(), partitions)
    read("first", "state-a", "reader", topic.COMMITTED)
    replay.sent(events.filter(F.col("event_id") > last), path, replay.in_order(), partitions)
    committed = read("committed", "state-b", "reader", topic.COMMITTED)
    goes_on = read("goes on", "state-a", "reader", topic.COMMITTED)
    earliest = read("earliest", "state-c", "reader", topic.EARLIEST)
    every = goes_on.unionByName(committed).unionByName(earliest)
    return every.groupBy("run", "partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("messages"))


_HOURS = f"""SELECT {batch.bucket('1 HOUR')} + INTERVAL 1 HOUR AS window_end, auction, count(*) AS n FROM ebid GROUP BY ALL"""


@query("topic_tuples", f"""
    SELECT '(' || auction || ',' || n || ')' AS value, CAST(auction % 4 AS INTEGER) AS "partition", window_end
    FROM ({_HOURS}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", "ebid")
def topic_tuples(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "tuples-from")
    bids = windows.with_watermark(tables.event_bids_from(sent.stream()), HOT_DELAY)
    counts = windows.windowed(bids, [F.count("*").alias("n")], "1 hour", keys=["auction"])
    value = F.format_string("(%d,%d)", "auction", "n")
    out, folder = shared_folder(spark, "tuples"), shared_folder(spark, "tuples-run")
    run_through(topic.to_topic(topic.messages(counts, value, F.col("window_end"), F.col("auction") % 4, F.col("auction")), out, folder))
    return zone_free(topic.read(spark, out).select("value", "partition", F.col("timestamp").alias("window_end")))


@query("topic_bids", "SELECT auction, bidder, price, epoch_us(ts) // 1000 AS \"dateTime\" FROM ebid", "ebid")
def topic_bids(spark, sf_dir):
    sent = replay.replay(spark, sf_dir, "bids-from")
    bids = tables.event_bids_from(sent.stream()).withColumn("dateTime", epoch_millis("ts"))
    body = F.to_json(F.struct("auction", "bidder", "price", "dateTime"))
    out, folder = shared_folder(spark, "bids"), shared_folder(spark, "bids-run")
    run_through(topic.to_topic(topic.messages(bids, body, F.col("ts"), F.col("auction") % 4), out, folder, "bids"))
    return codec.decode_bids(topic.read(spark, out)).select("auction", "bidder", "price", "dateTime")


def _halves(spark, sf_dir, label):
    """A topic that is sent in two halves: its path, the limit of a micro-batch, and what sends a half."""
    events = tables.events(spark, sf_dir)
    last, n = events.agg(F.floor(F.max("event_id") / 2), F.count("*")).first()
    path, partitions = shared_folder(spark, label), replay.partitions_of(n)

    def send(second):
        own = events.filter(F.col("event_id") > last if second else F.col("event_id") <= last)
        replay.sent(own, path, replay.in_order(), partitions)

    return path, replay.per_batch_of(n), last, send


@query("stream_state_audit", """
    WITH phases AS (SELECT 'stopped' AS phase, max(event_id) // 2 AS last FROM events UNION ALL SELECT 'went on', max(event_id) FROM events),
    marks AS (SELECT phase, last, max(ts) - INTERVAL 10 MINUTE AS wm FROM phases JOIN events ON event_id <= last GROUP BY phase, last)
    SELECT phase, a.id AS auction, a.expires, a.id % 5 AS seller, max(b.price) AS best
    FROM marks JOIN cauction a ON a.expires > marks.wm
    LEFT JOIN ubid b ON b.auction = a.id AND b.seq <= marks.last AND b.ts < a.expires GROUP BY ALL""", "ubid cauction")
def stream_state_audit(spark, sf_dir):
    # auctions that are still open when the stream stops, and again when it has gone on from its checkpoint
    path, limit, _, send = _halves(spark, sf_dir, "audit-topic")
    folder, found = shared_folder(spark, "audit"), []
    for second, phase in enumerate(("stopped", "went on")):
        send(second)
        events = replay.events_of(topic.stream(spark, path, None, topic.COMMITTED, limit, "audit"))
        auctions = tables.customer_auctions_from(tables.stream_table(spark, sf_dir, "customer")).withColumn("seller", F.pmod("id", F.lit(5)))
        run_live(live.last_sales(tables.user_bids_from(events), auctions, HOT_DELAY), "audit", folder)
        # the operator next to the source has the higher number
        open_ = each_kept(kept_state(spark, folder, 1, "auction")).select(F.col("key").alias("auction"), F.timestamp_micros("expires_us").alias("expires"), F.col("owner").alias("seller"))
        best = each_kept(kept_state(spark, folder, 1, "top")).select(F.col("key").alias("auction"), F.col("price").alias("best"))
        found.append(open_.join(best, "auction", "left").withColumn("phase", F.lit(phase)))
        # what was read is kept as it was then
        stored = f"{folder}/found{second}"
        found[-1].write.parquet(stored)
        found[-1] = spark.read.parquet(stored)
    return zone_free(found[0].unionByName(found[1]))


@query("stream_progress_of_run", f"""
    WITH {arrived_sql()}, half AS (SELECT max(event_id) // 2 AS last FROM events),
    runs AS (SELECT event_id <= last AS first_run, part, count(*) AS n, any_value(per_batch) AS per_batch FROM arrived, half GROUP BY ALL),
    batches AS (SELECT first_run, (max(n) + any_value(per_batch) - 1) // any_value(per_batch) AS batches FROM runs GROUP BY first_run)
    SELECT CAST((SELECT sum(batches) FROM batches) AS BIGINT) AS batches, (SELECT count(*) FROM events) AS input_rows,
           (SELECT count(*) FROM events) AS observed_rows, CAST(0 AS BIGINT) AS late_rows, CAST(1 AS BIGINT) AS restarts""")
def stream_progress_of_run(spark, sf_dir):
    path, limit, _, send = _halves(spark, sf_dir, "progress-topic")
    folder, reports = shared_folder(spark, "progress"), None
    for second in (False, True):
        send(second)
        events = replay.events_of(topic.stream(spark, path, None, topic.COMMITTED, limit, "progress"))
        own = run_live(observed_delay(events), "progress", folder)[1]
        reports = own if reports is None else reports.unionByName(own)
    reports = reports.filter("numInputRows > 0")
    told = telemetry.progress_table(reports).join(telemetry.observed_table(reports, LATENCY_METRICS), "id")
    return told.select("batches", "input_rows", "observed_rows", "late_rows", "restarts")


_RESUMED_SQL = """
    WITH half AS (SELECT max(event_id) // 2 AS last FROM events),
    u AS (SELECT seller AS k, seq, {'id': id, 'cat': category} AS item, NULL AS person FROM item
          UNION ALL SELECT id, seq, NULL, {'name': name, 'city': city, 'state': state} FROM member),
    w AS (SELECT seq, last_value(item IGNORE NULLS) OVER x AS la, last_value(person IGNORE NULLS) OVER x AS lp
          FROM u WINDOW x AS (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT lp.name AS name, lp.city AS city, lp.state AS state, la.id AS id FROM w, half
    WHERE seq > last AND la IS NOT NULL AND lp IS NOT NULL AND la.cat = 10 AND lp.state IN ('OR', 'ID', 'CA')"""


@query("stream_q3_latest_join_resumed", _RESUMED_SQL, "item member")
def stream_q3_latest_join_resumed(spark, sf_dir):
    # the first half is a finished table, the second comes as a stream
    path, limit, last, send = _halves(spark, sf_dir, "resumed-topic")
    send(True)
    history = lambda events: asof.latest_history(tables.event_items_from(events), tables.event_persons_from(events))
    snapshot = live.latest_snapshot(history(tables.events(spark, sf_dir).filter(F.col("event_id") <= last)))
    events = replay.events_of(topic.stream(spark, path, None, topic.COMMITTED, limit, "resumed"))
    return run_live(live.latest_join(_tagged_once(events), snapshot), "resumed")[0]


def _tagged_once(events):
    """``asof.latest_history`` of events that are read once: a purchase is an auction, a sign-up a person."""
    number, user = F.col("event_id"), F.col("user_id")
    state = tables.state_by_remainder(number)
    auction = F.struct(number.alias("seq"), number.alias("id"), F.when(number % 2 == 0, 10).otherwise(9).cast("long").alias("category"))
    member = F.struct(number.alias("seq"), F.concat(F.lit("user "), user.cast("string")).alias("name"), F.col("props").alias("city"), state.alias("state"))
    return events.filter(F.col("event_type").isin("purchase", "signup") & user.isNotNull()).select(
        user.alias("key"), number.alias("seq"),
        F.when(F.col("event_type") == "purchase", auction).alias("item"), F.when(F.col("event_type") == "signup", member).alias("person"),
    )


@query("stream_bid_auction_join_lifetime", """
    SELECT b.auction, b.seq, b.price, a.ts + INTERVAL 6 HOUR AS expires FROM ubid b
    JOIN events a ON a.event_type = 'signup' AND a.user_id = b.auction AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR""", "ubid")
def stream_bid_auction_join_lifetime(spark, sf_dir):
    # a longest lifetime lets both sides go once the watermark has passed it
    sent = replay.replay(spark, sf_dir, "lifetime-topic")
    bids = windows.with_watermark(tables.user_bids_from(sent.stream()), HOT_DELAY)
    opened = sent.stream().filter(F.col("event_type") == "signup").select(F.col("user_id").alias("id"), "ts", (F.col("ts") + F.expr("interval 6 hours")).alias("expires"))
    auctions = windows.with_watermark(opened, HOT_DELAY)
    joined = joins.bid_auction_join(bids, auctions, [], max_lifetime="6 hours", salts=2)
    return zone_free(run_live(joined.select("auction", "seq", "price", "expires"), "lifetime")[0])
