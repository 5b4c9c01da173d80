"""What a stream or a log costs does not go by its number of keys."""

from __future__ import annotations

import glob

import pandas as pd
from fixtures import BASE, MIN, auctions, persons, tuples
from pyspark.sql import functions as F
from test_joins import NCSI, offer_frames
from test_live import finished, in_batches, state_rows

from gavelspark.operators import asof, joins, telemetry
from gavelspark.sources import files
from gavelspark.streaming import live, processors, run, stateful

N = 4000


def test_logs_are_packed_in_few_files(spark, folder):
    lines = spark.range(600).select(
        F.concat(F.lit("log "), (F.col("id") % 300).cast("string")).alias("file"), (-F.col("id")).alias("line"),
        F.when(F.col("id") < 300, "2024-04-20 10:00:05,000 switched from INITIALIZING to RUNNING\tlate").otherwise("2024-04-20 10:00:00,000 Restoring job a from Checkpoint 1").alias("value"),
    )
    odd = spark.createDataFrame([(None, 1, "no name"), (None, None, None)], "file string, line long, value string")
    files.dump_log_lines(lines.unionByName(odd), folder)
    assert len(glob.glob(f"{folder}/**/part-*", recursive=True)) <= 8
    read = files.read_log_lines(spark, folder, "part-*", named=True)
    assert sorted(map(str, tuples(read.filter("file is null"), "value"))) == ["('',)", "('no name',)"]
    spans = telemetry.recovery_duration(read.filter("file is not null"))
    assert tuples(spans.select("span_micros").distinct(), "span_micros") == [(5_000_000,)] and spans.count() == 300


def test_joined_streams_keep_their_histories_in_files(spark, folder):
    """Either side may come first, in whatever micro-batch; every pair comes once, and there is no store of keyed state."""
    opened = [(i, i, i % 3, BASE, BASE + 10 * MIN) for i in range(40)]
    offered = [(100 + j, j % 50, 1, j, BASE + (j % 12) * MIN) for j in range(200)]
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True)
    stream = in_batches([both.filter(F.coalesce("auction", "id") % 3 == i) if i < 2 else both.filter((F.coalesce("auction", "id") % 3 == 2) & (F.col("id").isNull() if i == 2 else F.col("id").isNotNull())) for i in range(4)], folder)
    bids, own = stream.filter("auction is not null").select(*b.columns), stream.filter("id is not null").select(*a.columns)
    join = lambda x, y: joins.bid_auction_join(x, y, ["seller"], salts=2).select("auction", "price", "seller")
    got = run.run_joined(bids, own, join, "test", f"{folder}/run")
    assert tuples(got, "auction", "price", "seller") == sorted(map(tuple, join(b, a).collect()))
    assert len(glob.glob(f"{folder}/run/left/*/_SUCCESS")) == 4 and not glob.glob(f"{folder}/run/state/state")


class Kept:
    """A value or list state in memory."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return self.rows[0] if self.rows and not isinstance(self.rows[0][0], list) else iter(list(self.rows))

    def update(self, row):
        self.calls += 1
        self.rows = [row]

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def clear(self):
        self.calls += 1
        self.rows = []


class Handle:
    def __init__(self):
        self.states = {}

    def _state(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState = _state


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_versions_of_a_key_are_met_at_once():
    """Every other row is a version: a bid waits for the next one, the last for another micro-batch."""
    machine, handle = processors.WatermarkBuffer(), Handle()
    machine.init(handle)
    n = range(2 * N)
    rows = pd.DataFrame({
        "seq": n, "is_auction": [i % 2 == 1 for i in n], "price": [None if i % 2 else i for i in n], "ts_us": 10,
        "expires_us": [5 if i % 2 else None for i in n], "owner": [i if i % 4 == 1 else None for i in n],
    })
    out = list(machine.handleInputRows((3,), iter([rows]), Clock()))
    got = pd.concat(out)
    assert len(out) <= 3 and sum(state.calls for state in handle.states.values()) < 10
    assert [(p, None if pd.isna(o) else o) for p, o in zip(got["price"], got["owner"])] == [(i, i + 1 if i % 4 == 0 else None) for i in range(0, 2 * N, 2)]
    # one more bid waits, a live one does not
    rest = pd.DataFrame({"seq": [9000, 9001], "is_auction": False, "price": [1, 2], "ts_us": [4, 6], "expires_us": None, "owner": None})
    assert pd.concat(machine.handleInputRows((3,), iter([rest]), Clock()))["price"].tolist() == [1]
    version = pd.DataFrame({"seq": [9002], "is_auction": True, "price": None, "ts_us": [7], "expires_us": [9], "owner": [8]})
    assert pd.concat(machine.handleInputRows((3,), iter([version]), Clock()))[["price", "owner"]].values.tolist() == [[2, 8]]
    assert not handle.states["waiting"].rows


def test_latest_pairs_keep_state_by_part(spark, folder):
    big = 1 << 60
    items = [(i, big + i, i, 10) for i in range(N)]
    people = [(N + i, i, f"n{i}", "c", "OR") for i in range(0, N, 2)] + [(2 * N, 1, None, None, "CA")]
    early = asof.latest_history(auctions(spark, items), persons(spark, []))
    late = asof.latest_history(auctions(spark, []), persons(spark, people))
    found, reports = finished(live.latest_join(in_batches([late], folder), live.latest_snapshot(early)), folder)
    assert sorted(map(str, tuples(found.na.fill(""), *NCSI))) == sorted(map(str, [(n or "", c or "", s, big + i) for _, i, n, c, s in people]))
    assert 0 < state_rows(reports)[-1] <= stateful.KEY_PARTS


def _many_offers(spark, folder):
    """Auctions that stay open, one that ends in the first micro-batch, and a bid for each."""
    opened = [(i, i, i % 3, BASE, BASE + (2 if i == 7 else 600) * MIN) for i in range(N)]
    offered = [(N + i, i, 1, 10 + i, BASE + MIN) for i in range(N)]
    b, a = offer_frames(spark, offered, opened)
    both = b.unionByName(a, allowMissingColumns=True)
    later = both.limit(1).select(*[F.lit(9 * N).cast("long").alias("seq") if c == "seq" else F.timestamp_millis(F.lit(BASE + 10 * MIN)).alias("ts") if c == "ts" else F.lit(N + 5).cast("long").alias(c) if c in ("auction", "price", "bidder") else F.lit(None).cast(t).alias(c) for c, t in both.dtypes])
    stream = in_batches([both, later], folder)
    return stream.filter("auction is not null").select(*b.columns), stream.filter("id is not null").select(*a.columns)


def test_open_auctions_keep_state_by_part(spark, folder):
    found, reports = finished(live.last_sales(*_many_offers(spark, folder), "1 second"), folder)
    assert tuples(found, "auction", "final", "sales") == [(7, 17, 1)]
    # a part has its table, its best prices and a timer, which is two rows
    assert 0 < state_rows(reports)[-1] <= 4 * stateful.KEY_PARTS + 10
    kept = run.each_kept(run.kept_state(spark, f"{folder}/run", 1, "auction"))
    assert kept.count() == N - 1 and {r.key for r in kept.collect()} == set(range(N)) - {7}
    best = run.each_kept(run.kept_state(spark, f"{folder}/run", 1, "top"))
    assert tuples(best, "key", "price") == [(i, 10 + i) for i in range(N) if i != 7]


def test_expiry_timers_keep_state_by_part(spark, folder):
    b, a = _many_offers(spark, folder)
    found, reports = finished(stateful.expiry_timer_stream(b, a, "1 second", "seller"), folder)
    assert tuples(found, "auction", "price", "accepted") == [(i, 10 + i, True) for i in range(N)]
    assert 0 < state_rows(reports)[-1] <= 6 * stateful.KEY_PARTS
