from __future__ import annotations

import glob

import pytest
from fixtures import BASE, HIGHEST, bids, tuples
from pyspark.sql import Row
from pyspark.sql import functions as F

from gavelspark.functions import scalar
from gavelspark.operators import project
from gavelspark.schema import AUCTION, AUCTION_EVENT, BID, BID_EVENT, BROKER_RECORD, EVENT, PERSON, PERSON_EVENT
from gavelspark.session import shared_folder
from gavelspark.sources import broker, codec, files, generate

MESSAGES = ['{"auction":1,"bidder":2,"price":5,"dateTime":0,"extra":""}', "garbage", "{}", '{"auction":"x"}']


def messages(spark):
    return spark.createDataFrame([(m,) for m in [*MESSAGES, None]], "value string")


def test_malformed_messages(spark):
    decoded = codec.decode_bids(messages(spark)).select("auction", "bidder", "price").collect()
    assert sorted(decoded, key=str) == sorted([Row(auction=1, bidder=2, price=5), Row(auction=None, bidder=None, price=None)], key=str)
    dead = [r.value for r in codec.dead_letters(messages(spark), BID).collect()]
    assert sorted(map(str, dead)) == ["None", "garbage", '{"auction":"x"}']


@pytest.mark.parametrize("schema, make", [
    (BID, generate.gen_bids), (AUCTION, generate.gen_auctions), (PERSON, generate.gen_persons),
])
def test_round_trip(spark, schema, make):
    events = make(spark.range(50))
    assert [f.name for f in events.schema] == [f.name for f in schema]
    assert [f.dataType for f in events.schema] == [f.dataType for f in schema]
    back = codec.decode(codec.encode(events, schema), schema)
    if "expires" in events.columns:
        back = back.withColumn("expires", F.unix_millis("expires"))
    assert back.drop("ts").exceptAll(events).count() == 0 and back.count() == 50


def test_event_time_of_decoded(spark):
    decoded = codec.decode_bids(spark.createDataFrame([(f'{{"dateTime":{BASE}}}',)], "value string"))
    assert str(decoded.first().ts) == "2024-01-01 00:00:00"


def test_broker_frames(spark):
    rows = [(b"k", m.encode(), "bids", 0, i, None) for i, m in enumerate(MESSAGES)]
    topic = spark.createDataFrame(rows, BROKER_RECORD)
    assert broker.decode_topic(topic, BID).count() == 2
    assert [r.value for r in broker.message_values(topic).collect()] == MESSAGES


def test_broker_options():
    options = broker.source_options("host:1", "bids", "group", "latest")
    assert options == {
        "kafka.bootstrap.servers": "host:1", "subscribe": "bids", "startingOffsets": "latest", "kafka.group.id": "group",
    }
    assert broker.source_options("h", "t")["startingOffsets"] == "earliest"
    assert broker.sink_options("h", "t") == {"kafka.bootstrap.servers": "h", "topic": "t"}


def test_split_of_tagged_events(spark):
    bid = Row(auction=1, bidder=2, price=3, dateTime=4, extra="")
    rows = [(BID_EVENT, None, None, bid, 4), (PERSON_EVENT, None, None, None, 5), (AUCTION_EVENT, None, None, None, 6)]
    events = spark.createDataFrame(rows, EVENT)
    assert codec.split_events(events, BID_EVENT, "bid").drop("ts").collect() == [bid]
    assert codec.split_events(events, PERSON_EVENT, "person").count() == 1


def test_generators_depend_on_the_number_alone(spark):
    for make in (generate.gen_bids, generate.gen_auctions, generate.gen_persons):
        whole = make(spark.range(0, 1000, 1, 8))
        again = make(spark.range(0, 1000, 1, 3).repartition(5))
        assert whole.exceptAll(again).count() == 0
        part = make(spark.range(500, 600))
        assert part.exceptAll(whole).count() == 0 and part.count() == 100


def test_generated_events(spark):
    g = generate.gen_bids(generate.row_numbers(spark, 5000))
    times = [r.dateTime for r in g.select("dateTime").collect()]
    assert times == sorted(times)
    assert g.filter("price < 100 or auction < 1000 or bidder < 1000").count() == 0
    # three in four bids go to a hot auction
    hot = g.filter("auction % 100 = 0").count() / 5000
    assert 0.7 < hot < 0.8
    a = generate.gen_auctions(generate.row_numbers(spark, 2000))
    assert a.filter("expires <= dateTime or reserve < initialBid or category not between 10 and 14").count() == 0
    # big numbers do not overflow
    big = generate.gen_bids(spark.range(10**12, 10**12 + 5))
    assert big.count() == 5 and big.collect()


def test_rate_list(spark):
    texts = spark.createDataFrame([(0, "50000_300000_1000_600000"), (1, "10_1000_7"), (2, "5")], "k long, schedule string")
    parsed = generate.parse_schedule(texts, keys=["k"])
    want = [(0, 0, 50000, 300000), (0, 1, 1000, 600000), (1, 0, 10, 1000)]
    assert tuples(parsed, "k", "pos", "rate", "duration_ms") == want


@pytest.mark.parametrize("elapsed, want", [
    (0, [(50000, 300000), (1000, 600000)]), (100_000, [(50000, 200000), (1000, 600000)]),
    (400_000, [(1000, 500000)]), (900_000, []), (10**9, []),
])
def test_rest_of_a_rate_list(spark, elapsed, want):
    texts = spark.createDataFrame([("50000_300000_1000_600000",)], "schedule string")
    rest = generate.schedule_remaining(generate.parse_schedule(texts), elapsed)
    assert [(r.rate, r.duration_ms) for r in rest.orderBy("pos").collect()] == want


def test_offsets_in_a_schedule(spark):
    got = [r.offset_ms for r in generate.schedule_offsets(spark.range(8), [(2, 2000), (0, 500), (4, 500)]).orderBy("id").collect()]
    assert got == [0, 500, 1000, 1500, 2500, 2750]


def test_generated_to_files_and_back(spark, folder):
    out = f"{folder}/topic"
    files.dump_messages(codec.encode(generate.gen_bids(spark.range(20)), BID), out)
    assert codec.decode_bids(spark.read.text(out)).count() == 20


def test_int_lines(spark, folder):
    with open(f"{folder}/diffs.txt", "w") as f:
        f.write("-120\n 3\n1\n\nnone\n")
    assert tuples(files.read_int_lines(spark, f"{folder}/diffs.txt"), "value") == [(-120,), (1,), (3,)]


def test_csv_with_maps(spark, folder):
    df = spark.createDataFrame([("16:36:39", {0: 5}), ("16:36:41", {0: 7})], "at string, position map<int, long>")
    files.append_csv(df.coalesce(1), f"{folder}/csv")
    files.append_csv(df.coalesce(1), f"{folder}/csv")
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    assert back.count() == 4 and back.first().position == '{"0":5}'


def test_print_and_discard(spark, capsys):
    files.print_rows(spark.range(1))
    files.discard(spark.range(10))
    assert "id" in capsys.readouterr().out


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_scalar_functions(spark):
    row = spark.createDataFrame([(10, 0, 3, "a_b", BASE)], "p long, z long, n long, s string, t long").select(
        scalar.convert_price("p").alias("converted"),
        scalar.ratio_or_zero("p", "z").alias("guarded"),
        scalar.ratio_or_zero("p", "n").alias("ratio"),
        scalar.later("p", "n").alias("later"),
        scalar.split_longs(F.lit("5_10")).alias("numbers"),
        scalar.clock_time(F.timestamp_millis(F.col("t") + 59_000)).alias("clock"),
        scalar.log_time(F.lit("2024-04-20 10:00:00,123 INFO x")).cast("string").alias("logged"),
        scalar.log_time(F.lit("no time here")).alias("none"),
        scalar.micros_between(F.timestamp_micros(F.lit(5)), F.timestamp_micros(F.lit(2_000_009))).alias("micros"),
    ).first()
    assert row.asDict() == {
        "converted": 8, "guarded": 0.0, "ratio": 10 / 3, "later": 10, "numbers": [5, 10], "clock": "00:00:59",
        "logged": "2024-04-20 10:00:00.123", "none": None, "micros": 2_000_004,
    }


def test_currency_is_cut_not_rounded(spark):
    got = project.currency_conversion(bids(spark, [(1, 1, p, 0) for p in (1, 2, 99, 100, 1_000_000)])).collect()
    assert sorted(r.price for r in got) == [0, 1, 81, 82, 820_000]


def test_texts(spark):
    hot = spark.createDataFrame([(7, 3, BASE)], "auction long, n long, t long").withColumn("window_end", F.timestamp_millis("t"))
    assert project.hot_item_messages(hot).first().message == (
        f"Auction 7 had the highest number of bids: 3 in the window ending {BASE}"
    )
    assert project.tuple_messages(hot).first().value == "(7,3)"


def test_fixture_shape(spark):
    assert bids(spark, HIGHEST).count() == 9 and not glob.glob("spark-warehouse/*")
