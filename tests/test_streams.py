"""Streams give what batch gives; they forget nothing when restarted."""

from __future__ import annotations

import glob
import json
import tempfile
import time

import pytest
from conftest import SMALL
from fixtures import BASE, EVERY_WINDOW, HIGHEST, ITEMS, LOCAL, MIN, PEOPLE, PER_MINUTE, REVERSED, STRAGGLERS, auctions, bids, persons, tuples
from oracle import compare, connect
from pyspark.sql import functions as F
from test_joins import NCSI, history, offer_frames, offers, play_buffered, play_latest, play_pending, sellers

from gavelspark.operators import aggregates, joins, project, telemetry, windows
from gavelspark.plans import PLANS, SQL
from gavelspark.sources import tables
from gavelspark.sources.codec import encode
from gavelspark.sources.files import bounded_stream
from gavelspark.schema import BID
from gavelspark.streaming import carried, run, stateful
from gavelspark.streaming.windows import highest_bids_stream, hot_items_stream

APB = ("auction", "price", "bidder")


def in_files(df, folder, files=1, order="seq"):
    """The frame as a stream of ``files`` micro-batches, in the order of a column."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    ranked = df.withColumn("_file", F.floor((F.col(order) - low) * files / (high - low + 1)))
    for i in range(files):
        part = ranked.filter(F.col("_file") == i).drop("_file")
        stream = bounded_stream(part.coalesce(1), folder)
    return stream


def emitted(stream, folder):
    return run.run_available(stream, "test", f"{folder}/run")


def closed(result, df, delay):
    return windows.closed_windows(result, df, delay)


@pytest.mark.parametrize("rows", [HIGHEST, EVERY_WINDOW, STRAGGLERS, PER_MINUTE, REVERSED])
def test_highest_bid_per_auction(spark, folder, rows):
    df = bids(spark, rows)
    stream = windows.with_watermark(in_files(df, f"{folder}/in"), "10 seconds")
    got = emitted(aggregates.highest_bid_per_auction(stream), folder)
    assert tuples(got, *APB) == tuples(closed(aggregates.highest_bid_per_auction(df), df, "10 seconds"), *APB)


def test_ties_and_hot_items(spark, folder):
    df = bids(spark, [(i % 7, i, i % 5, i * 20_000) for i in range(300)])
    bid_stream = lambda name: windows.with_watermark(in_files(df, f"{folder}/{name}", 3), "10 seconds")
    got = emitted(highest_bids_stream(bid_stream("a"), "10 minutes"), f"{folder}/1")
    assert tuples(got, *APB) == tuples(closed(aggregates.highest_bids(df), df, "10 seconds"), *APB)
    got = emitted(hot_items_stream(bid_stream("b"), "20 minutes", "10 minutes"), f"{folder}/2")
    want = closed(aggregates.hot_items(df, "20 minutes", "10 minutes"), df, "10 seconds")
    assert tuples(got, "window_start", "auction", "n") == tuples(want, "window_start", "auction", "n")


def test_stateless_and_joins(spark, folder):
    df = bids(spark, HIGHEST)
    converted = emitted(project.currency_conversion(in_files(df, f"{folder}/bids", 2)), f"{folder}/1")
    assert tuples(converted, *APB) == tuples(project.currency_conversion(df), *APB)
    a, p = in_files(auctions(spark, ITEMS), f"{folder}/a", 2), in_files(persons(spark, PEOPLE), f"{folder}/p")
    assert tuples(emitted(joins.local_items(a, p, salts=2), f"{folder}/2"), *NCSI) == LOCAL


@pytest.mark.parametrize("salts", [1, 3])
def test_new_sellers(spark, folder, salts):
    p, a = sellers(spark)
    streams = [windows.with_watermark(in_files(df, f"{folder}/{i}"), "20 seconds") for i, df in enumerate((p, a))]
    got = emitted(joins.new_sellers(*streams, salts=salts), folder)
    assert tuples(got, "id", "reserve") == tuples(joins.new_sellers(p, a), "id", "reserve")


def test_late_rows_are_dropped_and_counted(spark, folder):
    files = [[(1, 1, 10, 0), (1, 2, 20, 700_000)], [(1, 4, 30, 710_000)], [(1, 3, 999, 5_000)]]
    for rows in files:
        stream = bounded_stream(bids(spark, rows).coalesce(1), f"{folder}/in")
    best = aggregates.highest_bid_per_auction(windows.with_watermark(stream, "20 seconds"))
    query = run.to_files(best, f"{folder}/run").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/run/out")
    assert tuples(got, "price", "bidder") == [(10, 1)]
    dropped = [sum(op["numRowsDroppedByWatermark"] for op in json.loads(line)["stateOperators"]) for line in run.progress_lines(query)]
    assert dropped[:3] == [0, 0, 1]

    run.save_progress(spark, run.progress_lines(query), f"{folder}/progress")
    reports = telemetry.parse_progress(spark.read.text(f"{folder}/progress"))
    assert telemetry.progress_table(reports).first().late_rows == 1


def test_recovery(spark, folder):
    """Half the input, a stop, the other half after a restart: the result of one run."""
    rows = [(1, i, (i * 37) % 101, i * MIN) for i in range(60)]
    df = bids(spark, rows)

    def start(stream):
        return carried.record_highs(stream.select("auction", "seq", "price", "bidder"), "auction", "test", f"{folder}/run")

    first = bounded_stream(df.filter("seq < 30").coalesce(1), f"{folder}/in")
    start(first)
    second = bounded_stream(df.filter("seq >= 30").coalesce(1), f"{folder}/in")
    got = start(second)
    want = aggregates.record_highs(df, "auction", "seq", 1 << 20, ["bidder"])
    assert tuples(got, "seq", "price") == tuples(want, "seq", "price")


def test_recovery_of_windows_timers_and_joins(spark, folder):
    offered, opened = offers(12)
    opened = list({row[1]: row for row in opened}.values())
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True)
    middle = both.agg(F.percentile_approx("seq", 0.5)).first()[0]

    def results(name, make):
        for half in (f"seq <= {middle}", f"seq > {middle}"):
            stream = bounded_stream(both.filter(half).coalesce(1), f"{folder}/in-{name}")
            got = emitted(make(stream.filter("auction is not null").select(*b.columns), stream.filter("id is not null").select(*a.columns)), f"{folder}/{name}")
        return got

    late = "1 hour"
    got = results("window", lambda x, _: aggregates.highest_bid_per_auction(windows.with_watermark(x, late), "1 minute"))
    want = windows.closed_windows(aggregates.highest_bid_per_auction(b, "1 minute"), b, late)
    assert tuples(got, *APB) == tuples(want, *APB)
    got = results("join", lambda x, y: joins.bid_auction_join(x, y, ["seller"]))
    assert tuples(got, *APB) == tuples(joins.bid_auction_join(b, a, ["seller"]), *APB)
    got = results("timer", lambda x, y: stateful.expiry_timer_stream(x, y, late, "seller"))
    assert tuples(got.filter("accepted"), *APB) == tuples(joins.bid_auction_join(b, a, ["seller"]), *APB)


@pytest.mark.parametrize("files", [1, 4])
def test_record_highs_and_averages(spark, folder, files):
    df = bids(spark, [(i % 3, i, None if i % 17 == 5 else (i * 37) % 101, (i * 7 % 50) * 1000) for i in range(90)] + [(None, 91, 5, 0)])
    stream = in_files(df, f"{folder}/in", files)
    high = carried.record_highs(stream.select("auction", "seq", "price", "bidder"), "auction", "test")
    want = aggregates.record_highs(df, "auction", "seq", 16, ["bidder"], hot_rows=None)
    assert tuples(high, "auction", "seq", "price") == tuples(want, "auction", "seq", "price")
    average = carried.running_average(stream.select("auction", "seq", "price"), "auction", "test")
    want = aggregates.running_average(df, "auction", [("seq", 16)])
    columns = ("auction", "seq", "running_count", "running_avg")
    assert tuples(average, *columns) == tuples(want, *columns)


@pytest.mark.parametrize("files", [1, 6])
def test_order_dependent_joins(spark, folder, files):
    items, people = history(9)
    # one source of tagged rows, so that both inputs arrive in the same order
    both = auctions(spark, items).withColumn("kind", F.lit("a")).unionByName(
        persons(spark, people).withColumn("kind", F.lit("p")), allowMissingColumns=True
    )
    both = in_files(both, f"{folder}/in", files)
    a = both.filter("kind = 'a'").select("seq", "id", "seller", "category")
    p = both.filter("kind = 'p'").select("seq", "id", "name", "city", "state")
    assert tuples(carried.pending_join(a, p, "test"), *NCSI) == play_pending(items, people)
    for prefilter in (False, True):
        latest = carried.latest_join(a, p, "test", prefilter=prefilter)
        assert tuples(latest, *NCSI) == play_latest(items, people, prefilter)


def offer_streams(spark, offered, opened, folder, files):
    b, a = offer_frames(spark, offered, opened)
    both = in_files(b.unionByName(a, allowMissingColumns=True), f"{folder}/in", files)
    return (
        both.filter("auction is not null").select(*b.columns),
        both.filter("id is not null").select(*a.columns),
    )


@pytest.mark.parametrize("files", [1, 6])
def test_buffered_join(spark, folder, files):
    offered, opened = offers(10)
    got = carried.buffered_join(*offer_streams(spark, offered, opened, folder, files), "test")
    got = got.withColumn("expires", F.unix_millis("expires"))
    assert tuples(got, "auction", "price", "expires", "seller") == play_buffered(offered, opened)


def test_hot_keys_are_not_gathered(spark, folder):
    """A third of the rows on one key: the carried operators run the chunked scan on each micro-batch."""
    df = bids(spark, [(0 if i % 3 == 0 else i, i, (i * 37) % 101, i * 1000) for i in range(300)])
    stream = in_files(df, f"{folder}/in", 3).select("auction", "seq", "price")
    got = carried.running_average(stream, "auction", "test", hot_rows=20)
    want = aggregates.running_average(df, "auction", [("seq", 16)])
    columns = ("auction", "seq", "running_count", "running_avg")
    assert tuples(got, *columns) == tuples(want, *columns)


def state_rows(query):
    return [sum(op["numRowsTotal"] for op in json.loads(line)["stateOperators"]) for line in run.progress_lines(query)]


def test_state_of_the_timer_ends(spark, folder):
    opened = [(0, 1, 7, BASE, BASE + 10_000)]
    files = [
        [(1, 1, 1, 100, BASE + 1000), (2, 1, 2, 200, BASE + 15_000), (3, 2, 3, 300, BASE + 2000)],
        [(4, 9, 1, 1, BASE + 40_000)], [(5, 9, 1, 1, BASE + 10 * MIN)], [(6, 9, 1, 1, BASE + 20 * MIN)], [(7, 9, 1, 1, BASE + 40 * MIN)],
    ]
    for i, rows in enumerate(files):
        b, a = offer_frames(spark, rows, opened if i == 0 else [])
        stream = bounded_stream(b.unionByName(a, allowMissingColumns=True).coalesce(1), f"{folder}/in")
    b, a = (stream.filter(f"{c} is not null").select(*f.columns) for c, f in (("auction", b), ("id", a)))
    out = stateful.expiry_timer_stream(b, a, "1 second", "seller", hold="5 minutes")
    query = run.to_files(out, f"{folder}/run").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuples(spark.read.parquet(f"{folder}/run/out"), "price", "accepted") == [(100, True), (200, False)]
    rows = state_rows(query)
    # only the last bid of the other auction still waits, with its deadline
    assert max(rows[:2]) > rows[-1] and rows[-1] <= 4


def test_state_of_the_join_ends(spark, folder):
    """With a longest lifetime, bids and auctions go once the watermark has passed it."""
    opened = [(i, i, 7, BASE + i * 1000, BASE + 60_000) for i in range(20)]
    offered = [(100 + i, i, i, 10 + i, BASE + i * 1000 + 500) for i in range(20)]
    far = [(200 + j, 999, 1, 1, BASE + (j + 1) * 60 * MIN) for j in range(2)]
    frames = [offer_frames(spark, offered, opened)] + [offer_frames(spark, [x], [(300 + x[0], 998, 7, x[4], x[4])]) for x in far]
    for b, a in frames:
        stream = bounded_stream(b.unionByName(a, allowMissingColumns=True).coalesce(1), f"{folder}/in")
    timed = lambda name, columns: windows.with_watermark(stream.filter(f"{name} is not null").select(*columns), "1 second")
    joined = joins.bid_auction_join(timed("auction", b.columns), timed("id", a.columns), ["seller"], max_lifetime="1 minute")
    query = run.to_files(joined, f"{folder}/run").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/run/out").count() == 20
    rows = state_rows(query)
    assert rows[0] >= 40 and rows[-1] <= 2


def test_zero_delay(spark, folder):
    """A delay of nothing: a window is over with the first event at its end."""
    for rows in ([(1, 1, 10, 0)], [(1, 2, 20, 10 * MIN)], [(1, 3, 5, 10 * MIN - 1), (1, 4, 7, 20 * MIN)]):
        stream = bounded_stream(bids(spark, rows).coalesce(1), f"{folder}/in")
    got = emitted(aggregates.highest_bid_per_auction(windows.with_watermark(stream)), folder)
    assert tuples(got, "price", "bidder") == [(10, 1), (20, 2)]


def test_a_running_stream_commits(spark, folder):
    stream = in_files(bids(spark, HIGHEST), f"{folder}/in", 2)
    query = run.checkpointed(run.to_memory(stream.select("price"), "committed_bids"), f"{folder}/state", "1 second").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("committed_bids").count() == 9
    assert glob.glob(f"{folder}/state/commits/*")


@pytest.mark.parametrize("files", [1, 5])
def test_expiry_timer(spark, folder, files):
    offered, opened = offers(11)
    opened = list({row[1]: row for row in opened}.values())  # one version per auction
    b, a = offer_streams(spark, offered, opened, folder, files)
    # rows are up to a minute late; a stream drops what is later than its delay
    got = emitted(stateful.expiry_timer_stream(b, a, "90 seconds", "seller"), folder)
    frames = offer_frames(spark, offered, opened)
    accepted = joins.bid_auction_join(*frames, ["seller"])
    rejected = joins.rejected_bids(*frames, ["seller"])
    assert tuples(got.filter("accepted"), "auction", "price", "bidder") == tuples(accepted, "auction", "price", "bidder")
    # ends after the last watermark have not passed yet
    last = max(row[3] for row in opened + [(0, 0, 0, r[4]) for r in offered])
    passed = rejected.filter(F.unix_millis("expires") <= last - 90_000)
    assert tuples(got.filter("not accepted"), "auction", "price", "bidder") == tuples(passed, "auction", "price", "bidder")
    assert rejected.count() > 0


def test_latency_sink(spark, folder):
    stream = in_files(bids(spark, HIGHEST), f"{folder}/in")
    query = run.latency_sink(stream).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    metrics = query.lastProgress.observedMetrics[run.LATENCY_METRICS]
    assert metrics["rows"] == 9 and metrics["max_ms"] >= metrics["mean_ms"] > 0


def test_progress_log(spark, folder):
    log = run.ProgressLog(spark, f"{folder}/log", per_file=1)
    spark.streams.addListener(log)
    try:
        emitted(project.currency_conversion(in_files(bids(spark, HIGHEST), f"{folder}/in", 2)), folder)
        for _ in range(100):  # listeners run on their own
            if glob.glob(f"{folder}/log/part-*"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    reports = telemetry.parse_progress(spark.read.text(f"{folder}/log"))
    assert telemetry.progress_table(reports).first().input_rows >= 1


def test_bids_to_a_topic_of_files(spark, folder):
    stream = in_files(bids(spark, HIGHEST), f"{folder}/in")
    sent = emitted(encode(stream, BID), folder)
    assert json.loads(sent.first().value).keys() == {"auction", "bidder", "price", "dateTime"}


def test_rows_in_memory(spark, folder):
    stream = in_files(bids(spark, HIGHEST), f"{folder}/in")
    query = run.to_memory(stream.select("auction", "price"), "seen_bids").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen_bids").count() == 9


def test_partial_results_merge(spark, folder):
    df = bids(spark, [(i % 3, i, (i * 37) % 101, i * 1000) for i in range(60)])
    best = lambda rows: rows.groupBy("auction").agg(F.max("price").alias("price"), F.sum("n").alias("n"))
    stream = in_files(df, f"{folder}/in", 4).withColumn("n", F.lit(1))
    parts = run.run_partials(stream, {"best": best}, "test", f"{folder}/run")["best"]
    assert parts.count() == 12 and parts.columns == ["auction", "price", "n"]
    assert tuples(best(parts), "auction", "price", "n") == tuples(best(df.withColumn("n", F.lit(1))), "auction", "price", "n")


def test_no_micro_batch_no_rows(spark, folder):
    spark.range(0).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("auction long, price long").option("pathGlobFilter", "none").parquet(f"{folder}/in")
    parts = run.run_partials(stream, {"all": lambda rows: rows.select("price")}, "test")["all"]
    assert parts.count() == 0 and parts.columns == ["price"]


# the whole registry over tables that are cut into files

STREAMS = sorted(name for name, plan in PLANS.items() if plan.__module__ == "gavelspark.plans.streams" and name.startswith("stream_"))
# these need files in the order of arrival
ORDERED = {
    "stream_record_highs", "stream_running_avg", "stream_q3_pending_join", "stream_q3_latest_join",
    "stream_q3_latest_join_prefiltered", "stream_bid_auction_buffered", "stream_expired_bid_flush",
}
KEYS = {"events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}


@pytest.fixture(scope="module")
def cut_tables(spark):
    """The tables as folders of four files: in the order of their key, and at random."""
    base = tempfile.mkdtemp(prefix="gavelspark-cut-")
    for name, key in KEYS.items():
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        low, high = table.agg(F.min(key), F.max(key)).first()
        cuts = {"ordered": F.floor((F.col(key) - low) * 4 / (high - low + 1)), "random": F.pmod(F.xxhash64(*table.columns), F.lit(4))}
        for how, number in cuts.items():
            for i in range(4):
                table.filter(number == i).coalesce(1).write.mode("append").parquet(f"{base}/{how}/{name}.parquet")
    for how in ("ordered", "random"):
        spark.read.parquet(f"{SMALL}/nation.parquet").write.parquet(f"{base}/{how}/nation.parquet")
    return base


@pytest.fixture(scope="module")
def con():
    connection = connect(SMALL)
    yield connection
    connection.close()


@pytest.mark.parametrize("how, name", [("ordered", n) for n in STREAMS] + [("random", n) for n in STREAMS if n not in ORDERED])
def test_results_do_not_depend_on_files(spark, con, cut_tables, monkeypatch, how, name):
    monkeypatch.setattr(tables, "BATCH_BYTES", 1)  # a file is a micro-batch
    _, _, problem = compare(spark, con, PLANS[name], SQL[name], SMALL, f"{cut_tables}/{how}")
    assert problem is None


@pytest.mark.parametrize("name", sorted(ORDERED - {"stream_expired_bid_flush"}))
def test_files_out_of_order_fail_unless_in_one_micro_batch(spark, con, cut_tables, monkeypatch, name):
    _, _, problem = compare(spark, con, PLANS[name], SQL[name], SMALL, f"{cut_tables}/random")
    assert problem is None
    monkeypatch.setattr(tables, "BATCH_BYTES", 1)
    with pytest.raises(Exception, match="files have to come in the order of seq"):
        PLANS[name](spark, f"{cut_tables}/random").count()


def test_files_are_micro_batches(spark, cut_tables, monkeypatch):
    monkeypatch.setattr(tables, "BATCH_BYTES", 1)
    sizes = []
    query = tables.stream_table(spark, f"{cut_tables}/ordered", "events").writeStream.foreachBatch(lambda rows, _: sizes.append(rows.count()))
    query.trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) >= 3 and sum(sizes) == 1000
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.stream_table(spark, cut_tables, "events")
