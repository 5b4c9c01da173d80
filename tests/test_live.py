"""Topics in files, and operators under a live watermark in several micro-batches."""

from __future__ import annotations

import glob
import random
import time

import pyarrow as pa
import pytest
from fixtures import BASE, MIN, auctions, persons, tuples
from pyspark.sql import functions as F
from test_joins import NCSI, history, offer_frames, offers, play_buffered, play_latest

from gavelspark.operators import aggregates, asof, windows
from gavelspark.operators.samples import ragged_samples
from gavelspark.sources import topic
from gavelspark.sources.files import bounded_stream
from gavelspark.streaming import live, run
from gavelspark.streaming.windows import hot_items_stream


def numbered(spark, n, partitions=2, start=0):
    """Messages whose value is their number."""
    rows = spark.range(start, start + n).withColumn("ts", F.timestamp_millis(F.col("id") * 1000 + BASE))
    sent = topic.messages(rows, F.col("id").cast("string"), F.col("ts"), F.col("id") % partitions, F.col("id"))
    return sent.repartition(partitions, "partition").sortWithinPartitions("partition", "timestamp")


def in_batches(frames, folder):
    """One micro-batch for each frame."""
    for frame in frames:
        stream = bounded_stream(frame.coalesce(1), f"{folder}/in")
    return stream


def finished(stream, folder):
    return run.run_live(stream, "test", f"{folder}/run")


def state_rows(reports):
    """Rows of all state stores, by micro-batch."""
    total = F.aggregate("stateOperators", F.lit(0).cast("long"), lambda n, op: n + op["numRowsTotal"])
    return [r.n for r in reports.select("batchId", total.alias("n")).orderBy("batchId").collect()]


# topics

def test_offsets_follow_the_order_of_sending(spark, folder):
    for start in (0, 100):
        topic.send(numbered(spark, 100, 2, start), folder)
    rows = topic.read(spark, folder).collect()
    assert sorted((r.partition, r.offset, int(r.value)) for r in rows) == [(p, i, 2 * i + p) for p in range(2) for i in range(100)]
    assert {r.key for r in rows} == {r.value for r in rows}


def test_a_stream_takes_so_many_at_a_time_and_goes_on(spark, folder):
    path, seen = f"{folder}/topic", []

    def read(state, **options):
        sizes = []
        stream = topic.stream(spark, path, per_batch=30, **options)
        query = stream.writeStream.foreachBatch(lambda rows, _: sizes.append(sorted(int(r.value) for r in rows.collect()))).option("checkpointLocation", f"{folder}/{state}")
        run.run_through(query)
        return sizes

    topic.send(numbered(spark, 100), path)
    seen = read("a", group="g", name="a")
    assert [len(x) for x in seen] == [60, 40] and seen[0] == list(range(60))
    topic.send(numbered(spark, 50, 2, 100), path)
    assert sum(read("a", group="g", name="a"), []) == list(range(100, 150))
    # the last micro-batch of a group is not committed before the next one begins
    assert sum(read("b", group="g", name="b"), []) == list(range(100, 150))
    assert sum(read("c", group="g", starting=topic.EARLIEST, name="c"), []) == list(range(150))
    # a group that has committed nothing begins at the earliest offset; without a name all comes at once
    assert [len(x) for x in read("d", group="other")] == [150]
    assert read("a", group="g", name="a") == []


def test_an_empty_topic(spark, folder):
    path = f"{folder}/topic"
    assert topic.read(spark, path).count() == 0
    found, reports = finished(topic.stream(spark, path, per_batch=5, name="x"), folder)
    assert found.count() == 0
    topic.send(numbered(spark, 10), path)
    assert finished(topic.stream(spark, path, per_batch=5, name="x"), folder)[0].count() == 10


def test_files_without_a_record_are_not_read(spark, folder):
    """A run that was killed between the writing of a batch and its record left files: the batch is written again, and counts once."""
    kept = topic.Topic(folder)
    batch = pa.RecordBatch.from_pydict({"partition": pa.array([0, 1, 0], pa.int32()), "key": ["a", "b", "c"], "value": ["1", "2", "3"], "timestamp": pa.array([1, 2, 3], pa.timestamp("us", tz="UTC"))})
    killed = kept.write_messages(iter([batch]))
    assert topic.read(spark, folder).count() == 0 and kept.ends() == {}
    again = kept.write_messages(iter([batch]))
    assert kept.record("p-0", [again, None]) and kept.ends() == {"0": 2, "1": 1}
    # and killed between the record and Spark's own note of the batch
    third = kept.write_messages(iter([batch]))
    assert not kept.record("p-0", [third]) and kept.ends() == {"0": 2, "1": 1}
    assert sorted(r.value for r in topic.read(spark, folder).collect()) == ["1", "2", "3"]
    names = {name.rsplit("/", 1)[1] for name in glob.glob(f"{folder}/data/*.parquet")}
    assert names == {file[1] for file in [*killed.files, *again.files]}
    # a batch of another producer, or number, counts
    assert kept.record("q-0", [kept.write_messages(iter([batch]))]) and kept.record("p-1", [kept.write_messages(iter([batch]))])
    assert kept.ends() == {"0": 6, "1": 3}


def test_batches_that_are_run_again_change_nothing(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"
    topic.send(numbered(spark, 90), source)
    for attempt in range(2):  # without a checkpoint all batches come again, under the same numbers
        rows = topic.stream(spark, source, per_batch=15, name=f"r{attempt}").select("partition", "key", "value", "timestamp")
        run.run_through(topic.to_topic(rows, target, f"{folder}/state{attempt}", "copy"))
        assert sorted(int(r.value) for r in topic.read(spark, target).collect()) == list(range(90))
    run.run_through(topic.to_topic(topic.stream(spark, source, name="r2").select("partition", "key", "value", "timestamp"), target, f"{folder}/state2", "other"))
    assert topic.read(spark, target).count() == 180


# windows that close

def people_and_items(spark, folder, minutes):
    """A person and an auction of theirs in each ten minutes, minute after minute."""
    both = spark.range(minutes).select(
        F.col("id").alias("seq"), (F.floor(F.col("id") / 10) % 7).alias("id"), F.lit("n").alias("name"), (F.floor(F.col("id") / 10) % 7).alias("seller"), (F.col("id") % 3).alias("reserve"),
        F.timestamp_millis(F.col("id") * MIN + BASE).alias("ts"),
    )
    cuts = [both.filter((F.col("seq") * 8 / minutes).cast("int") == i) for i in range(8)]
    stream = in_batches(cuts, folder)
    p = stream.filter("seq % 10 = 0").select("id", "name", "ts")
    a = stream.filter("seq % 10 = 3").select("seller", "reserve", "ts")
    return both, p, a


def test_closed_windows_of_two_streams(spark, folder):
    both, p, a = people_and_items(spark, folder, 400)
    joined = live.closed_new_sellers(windows.with_watermark(p, "1 minute"), windows.with_watermark(a, "45 minutes"), "30 minutes")
    found, reports = finished(joined, folder)
    rows = both.collect()
    people = [(r.id, r.ts) for r in rows if r.seq % 10 == 0]
    items = [(r.seller, r.reserve, r.ts) for r in rows if r.seq % 10 == 3]
    end = lambda ts: (int(ts.timestamp()) // 1800 + 1) * 1800
    # the smaller watermark counts
    over = min(max(int(ts.timestamp()) for _, ts in people) - 60, max(int(ts.timestamp()) for *_, ts in items) - 45 * 60)
    want = sorted((i, reserve) for i, ts in people for seller, reserve, at in items if i == seller and end(ts) == end(at) <= over)
    assert tuples(found, "id", "reserve") == want and want
    held = state_rows(reports)
    assert held[-1] <= max(held) and held[-1] < 40


def test_state_of_closed_windows_does_not_grow(spark, folder):
    held = []
    for minutes in (400, 1600):
        _, p, a = people_and_items(spark, f"{folder}/{minutes}", minutes)
        joined = live.closed_new_sellers(windows.with_watermark(p, "1 minute"), windows.with_watermark(a, "1 minute"), "30 minutes", salts=2)
        held.append(state_rows(finished(joined, f"{folder}/{minutes}")[1])[-1])
    assert held[1] <= held[0] + 8


def test_state_of_hot_items_does_not_grow(spark, folder):
    held = []
    for n in (400, 1600):
        df = spark.range(n).select((F.col("id") % 7).alias("auction"), F.col("id").alias("seq"), F.timestamp_millis(F.col("id") * 20_000 + BASE).alias("ts"))
        stream = windows.with_watermark(in_batches([df.filter((F.col("seq") * 4 / n).cast("int") == i) for i in range(4)], f"{folder}/{n}"), "1 minute")
        found, reports = finished(hot_items_stream(stream, "20 minutes", "10 minutes"), f"{folder}/{n}")
        assert tuples(found, "window_start", "auction", "n") == tuples(windows.closed_windows(aggregates.hot_items(df, "20 minutes", "10 minutes"), df, "1 minute"), "window_start", "auction", "n")
        held.append(state_rows(reports)[-1])
    assert held[1] <= 1.5 * held[0]


# late rows

def test_late_rows_are_told_and_kept(spark, folder):
    kind = "id long, big long, name string, nested struct<x: double, at: timestamp_ntz>, ts timestamp"

    frames = []
    for rows in ([(1, 0), (2, 25)], [(3, 3), (4, 31), (5, None)], [(6, 12), (7, 24), (8, 29)]):
        frames.append(spark.createDataFrame([(i, (1 << 60) + i if i % 2 else None, None if i == 4 else f"n{i}", (i / 7, None)) for i, _ in rows], "id long, big long, name string, nested struct<x: double, at: timestamp_ntz>"))
        minute = F.create_map(*[F.lit(x) for i, m in rows for x in (i, m if m is not None else -1)])[F.col("id")]
        frames[-1] = frames[-1].withColumn("ts", F.when(minute >= 0, F.timestamp_millis(F.lit(BASE) + minute * MIN + 1).cast("timestamp"))).to(spark.createDataFrame([], kind).schema)
    marked, _ = finished(live.late_rows(in_batches(frames, folder), "10 minutes", "5 minutes"), folder)
    assert set(marked.columns) == {"id", "big", "name", "nested", "ts", "is_late", "watermark_ms"}
    # after the first micro-batch the watermark is at minute 20, after the second at minute 26
    assert tuples(marked, "id", "is_late") == [(1, False), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False), (8, False)]
    assert sorted({r.watermark_ms for r in marked.collect()}) == [0, BASE + 20 * MIN + 1, BASE + 26 * MIN + 1]
    got = {r.id: r for r in marked.collect()}
    assert got[3].big == (1 << 60) + 3 and got[4].big is None and got[4].name is None and got[5].ts is None and got[7].nested.x == 1.0
    on_time, late = live.on_time_and_late(marked)
    assert on_time.count() == 6 and tuples(late, "id") == [(3,), (6,)]


# sales in a row

@pytest.mark.parametrize("files", [1, 5])
def test_last_sales_against_a_replay(spark, folder, files):
    rng = random.Random(21)
    opened = [(i, i, rng.randrange(3), BASE + i * 1000, BASE + i * 1000 + rng.randrange(5, 60) * 1000) for i in range(80)]
    # some bids come before their auction, some after its end, some have none
    offered = [(1000 + j, rng.randrange(90), j, rng.randrange(1000), BASE + rng.randrange(140) * 1000 + 7) for j in range(400)]
    offered.append((5000, 999, 1, 1, BASE + 400_000))
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True)
    cuts = [both.filter(F.least(F.lit(files - 1), ((F.unix_millis("ts") - BASE) * files / 160_000).cast("int")) == i) for i in range(files)]
    stream = in_batches(cuts, folder)
    b, a = stream.filter("auction is not null").select(*b.columns), stream.filter("id is not null").select(*a.columns)
    found, reports = finished(live.last_sales(b, a, "2 seconds", n=4, hold="5 minutes"), folder)
    over, recent, want = BASE + 398_000, {}, []
    for _, i, seller, ts, expires in sorted(opened, key=lambda x: (x[4], x[1])):
        prices = [price for _, auction, _, price, at in offered if auction == i and at < expires]
        if prices and expires <= over:
            ring = recent[seller] = [*recent.get(seller, []), max(prices)][-4:]
            want.append((i, seller, max(prices), len(ring), sum(ring) / len(ring)))
    assert tuples(found, "auction", "seller", "final", "sales", "avg_final") == sorted(want)


def test_state_of_last_sales_ends(spark, folder):
    opened = [(i, i, i % 2, BASE + i * 1000, BASE + i * 1000 + 5000) for i in range(60)]
    offered = [(100 + i, i, 1, 10 + i, BASE + i * 1000 + 100) for i in range(60)] + [(900, 77, 1, 1, BASE + 10 * MIN), (901, 78, 1, 1, BASE + 40 * MIN)]
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True)
    stream = in_batches([both.filter(F.unix_millis("ts") < BASE + 9 * MIN), both.filter("seq = 900"), both.filter("seq = 901")], folder)
    found, reports = finished(live.last_sales(stream.filter("auction is not null").select(*b.columns), stream.filter("id is not null").select(*a.columns), "1 second", hold="1 minute"), folder)
    assert found.count() == 60
    # two rings of ten prices, and a bid that waits for its auction
    assert state_rows(reports)[-1] < 40


# bids that wait

@pytest.mark.parametrize("files", [1, 6])
def test_live_buffered_join(spark, folder, files):
    offered, opened = offers(12)
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True).select("seq", "ts", "auction", "price", "id", "expires", "seller")
    cuts = [both.filter((F.col("seq") * files / 240).cast("int") == i) for i in range(files)]
    got, _ = finished(live.buffered_join(in_batches(cuts, folder), "10 seconds"), folder)
    # the watermark of a micro-batch: by batch what came before it
    batch = lambda row: row[0] * files // 240
    out, known, waiting = [], {}, {}
    for row in sorted(offered + opened):
        now = max([r[4] if r in offered else r[3] for r in offered + opened if batch(r) < batch(row)], default=None)
        now = 0 if now is None else now - 10_000
        if row in opened:
            known[row[1]] = (row[4], row[2])
            out += [(row[1], price, row[4], row[2]) for price in waiting.pop(row[1], ())]
        else:
            expires, seller = known.get(row[1], (0, None))
            if expires > row[4] and expires > now:
                out.append((row[1], row[3], expires, seller))
            else:
                waiting.setdefault(row[1], []).append(row[3])
    assert tuples(got.withColumn("expires", F.unix_millis("expires")), "auction", "price", "expires", "seller") == sorted(out)
    if files == 1:
        assert sorted(out) == play_buffered(offered, opened)


# state from a snapshot

def test_latest_join_goes_on_from_a_snapshot(spark, folder):
    items, people = history(13)
    half = 120
    frame = lambda rows, make: make(spark, rows)
    early = asof.latest_history(frame([r for r in items if r[0] < half], auctions), frame([r for r in people if r[0] < half], persons))
    late = [asof.latest_history(frame([r for r in items if lo <= r[0] < lo + 40], auctions), frame([r for r in people if lo <= r[0] < lo + 40], persons)) for lo in (120, 160, 200)]
    stream = in_batches(late, folder)
    got, _ = finished(live.latest_join(stream, live.latest_snapshot(early)), folder)
    every, first = play_latest(items, people, False), play_latest([r for r in items if r[0] < half], [r for r in people if r[0] < half], False)
    assert tuples(got, *NCSI) == sorted(take_away(every, first))


def test_latest_join_that_forgets(spark, folder):
    """A stream whose state ends by the clock has a micro-batch whenever it is asked, so it is stopped from outside."""
    items, people = history(13)
    stream = in_batches([asof.latest_history(auctions(spark, items), persons(spark, people))], folder)
    query = run.to_files(live.latest_join(stream, ttl="1 hour"), f"{folder}/run").start()
    try:
        for _ in range(60):
            if query.lastProgress and query.lastProgress.batchId >= 1:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert tuples(spark.read.parquet(f"{folder}/run/out"), *NCSI) == play_latest(items, people, False)


def take_away(rows, gone):
    left = list(rows)
    for row in gone:
        left.remove(row)
    return left


# ragged samples

def plain_samples(times, width):
    times = sorted(times)
    out, began = [], None
    for t in times:
        if began is None:
            began, n = t, 0
        elif t >= began + width:
            out.append((began, t, n))
            began, n = t, 0
        n += 1
    return out


@pytest.mark.parametrize("kind", ["even", "bursts", "gaps", "one instant", "one"])
def test_ragged_samples_against_a_replay(spark, kind):
    rng = random.Random(4)
    times = {
        "even": [i * 700_000 for i in range(300)],
        "bursts": [rng.randrange(40) * 3_000_000 + rng.randrange(900_000) for _ in range(400)],
        "gaps": [rng.choice([0, 500, 10_000]) * 1_000_000 + rng.randrange(90_000_000) for _ in range(300)],
        "one instant": [5_000_000] * 200 + [7_000_000] * 200 + [6_999_999, 9_000_001],
        "one": [1],
    }[kind]
    rows = [(k, BASE * 1000 + t) for k in (1, 2) for t in times[k - 1 :]]
    df = spark.createDataFrame([*rows, (None, BASE * 1000), (1, None)], "k long, us long").select("k", F.timestamp_micros("us").alias("ts"))
    got = ragged_samples(df, "2 seconds", keys=["k"])
    want = sorted((k, *row) for k in (1, 2) for row in plain_samples([us for key, us in rows if key == k], 2_000_000))
    assert tuples(got.withColumn("began", F.unix_micros("began")).withColumn("ended", F.unix_micros("ended")), "k", "began", "ended", "messages") == want
    assert all(abs(r.per_second - r.messages / (r.ended - r.began).total_seconds()) < 1e-6 for r in got.collect())
    whole = ragged_samples(df.filter("k = 1"), "2 seconds")
    assert whole.columns == ["began", "ended", "messages", "per_second"] and whole.count() == len(plain_samples(times, 2_000_000))
