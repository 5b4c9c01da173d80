from __future__ import annotations

import random

import pytest
from fixtures import BASE, ITEMS, LOCAL, PEOPLE, VERSION_ITEMS, VERSIONS, auctions, bids, persons, tuples
from pyspark.sql import functions as F

from gavelspark.operators import asof, joins, project

NCSI = ("name", "city", "state", "id")


def test_local_items(spark):
    a, p = auctions(spark, ITEMS), persons(spark, PEOPLE)
    assert tuples(joins.local_items(a, p), *NCSI) == LOCAL
    assert tuples(joins.local_items(a, p, salts=3), *NCSI) == LOCAL
    assert tuples(asof.latest_join(a, p), *NCSI) == LOCAL
    assert len(tuples(joins.local_items(a, p, category=None), *NCSI)) == 3


def test_local_items_within_a_gap(spark):
    a = auctions(spark, ITEMS).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    p = persons(spark, PEOPLE).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    assert tuples(joins.local_items(a, p, max_gap="4 minutes"), *NCSI) == LOCAL[:1]


def test_nobody_lives_in_no_state(spark):
    p = persons(spark, [(0, 1, "A", "B", None), (1, 2, "C", "D", "OR")])
    assert tuples(project.in_states(p), "id") == [(2,)]


def test_three_readings_of_versions(spark):
    a, p = auctions(spark, VERSION_ITEMS), persons(spark, VERSIONS)
    assert len(tuples(joins.local_items(a, p), *NCSI)) == 6
    for how in ({}, {"chunk": 1, "hot_rows": None}, {"chunk": 2, "hot_rows": 0}):
        assert tuples(asof.pending_join(a, p, **how), "id", "city") == [(10, "Bend"), (11, "Bend"), (12, "Bend")]
        assert tuples(asof.latest_join(a, p, **how), "id", "city") == [(11, "Bend"), (12, "Bend"), (12, "Salem")]


STATES = ["OR", "ID", "CA", "WA", "NV"]


def history(seed, n=240):
    """Arrivals of auctions and persons; a third belongs to seller 0."""
    rng = random.Random(seed)
    items, people = [], []
    for seq in range(n):
        seller = 0 if rng.random() < 0.34 else rng.randrange(1, 8)
        if rng.random() < 0.6:
            # some auctions arrive twice
            items.append((seq, rng.randrange(n // 2) * 10 + seller, seller, rng.choice([9, 10])))
        else:
            people.append((seq, seller, f"p{seller}", f"city {seq}", rng.choice(STATES)))
    return items, people


def play_pending(items, people):
    known, waiting, out = {}, {}, []
    for seq, *rest in sorted(items + people):
        if len(rest) == 3:
            id_, seller, _ = rest
            if seller in known:
                out.append((*known[seller], id_))
            else:
                waiting.setdefault(seller, set()).add(id_)
        else:
            seller, *person = rest
            if person[2] in project.LOCAL_STATES:
                known[seller] = tuple(person)
                out += [(*person, id_) for id_ in waiting.pop(seller, ())]
    return sorted(out)


def play_latest(items, people, prefilter):
    person, item, out = {}, {}, []
    for seq, *rest in sorted(items + people):
        if len(rest) == 3:
            seller = rest[1]
            item[seller] = (rest[0], rest[2])
        else:
            seller = rest[0]
            if prefilter and rest[3] not in project.LOCAL_STATES:
                continue
            person[seller] = tuple(rest[1:])
        if seller in person and seller in item:
            if item[seller][1] == 10 and person[seller][2] in project.LOCAL_STATES:
                out.append((*person[seller], item[seller][0]))
    return sorted(out)


@pytest.mark.parametrize("chunk, hot_rows", [(1, None), (7, 40), (64, None), (64, 10_000)])
def test_asof_joins_against_a_replay(spark, chunk, hot_rows):
    items, people = history(chunk)
    a, p = auctions(spark, items), persons(spark, people)
    assert tuples(asof.pending_join(a, p, chunk=chunk, hot_rows=hot_rows), *NCSI) == play_pending(items, people)
    for prefilter in (False, True):
        got = tuples(asof.latest_join(a, p, prefilter=prefilter, chunk=chunk, hot_rows=hot_rows), *NCSI)
        assert got == play_latest(items, people, prefilter)


def offers(seed, n=240):
    """Bids and auction versions (some auctions come twice) with out-of-order event times."""
    rng = random.Random(seed)
    offered, opened = [], []
    for seq in range(n):
        auction, ts = rng.randrange(6), BASE + 1000 * (seq + rng.randrange(-30, 30))
        if rng.random() < 0.1:
            opened.append((seq, auction, 100 + auction, ts, ts + 1000 * rng.randrange(5, 60)))
        else:
            offered.append((seq, auction, seq, rng.randrange(500), ts))
    return offered, opened


def play_buffered(offered, opened, delay_ms=None):
    auction, waiting, out, latest = {}, {}, [], None
    for row in sorted(offered + opened):
        if row in opened:
            seq, id_, seller, ts, expires = row
            auction[id_] = (expires, seller)
            out += [(id_, price, expires, seller) for price in waiting.pop(id_, ())]
            continue
        seq, id_, bidder, price, ts = row
        watermark = None if latest is None or delay_ms is None else latest - delay_ms
        expires, seller = auction.get(id_, (None, None))
        if expires is not None and expires > ts and (watermark is None or expires > watermark):
            out.append((id_, price, expires, seller))
        else:
            waiting.setdefault(id_, []).append(price)
        latest = ts if latest is None else max(latest, ts)
    return sorted(out)


def offer_frames(spark, offered, opened):
    b = spark.createDataFrame(offered, "seq long, auction long, bidder long, price long, dateTime long")
    a = spark.createDataFrame(opened, "seq long, id long, seller long, dateTime long, end long")
    return (
        b.withColumn("ts", F.timestamp_millis("dateTime")),
        a.withColumn("ts", F.timestamp_millis("dateTime")).withColumn("expires", F.timestamp_millis("end")),
    )


@pytest.mark.parametrize("chunk, hot_rows", [(1, None), (16, 40), (16, 10_000)])
@pytest.mark.parametrize("delay", [None, 5])
def test_buffered_join_against_a_replay(spark, chunk, hot_rows, delay):
    offered, opened = offers(5)
    b, a = offer_frames(spark, offered, opened)
    if delay:
        b = asof.with_arrival_watermark(b, f"{delay} seconds", [("seq", chunk)])
    got = asof.buffered_join(b, a, chunk=chunk, hot_rows=hot_rows).withColumn("expires", F.unix_millis("expires"))
    want = play_buffered(offered, opened, delay and delay * 1000)
    assert tuples(got, "auction", "price", "expires", "seller") == want


def expiring(spark):
    a = spark.createDataFrame([(1, 5)], "id long, category long").select(
        "id", "category", F.timestamp_millis(F.lit(BASE)).alias("ts"), F.timestamp_millis(F.lit(BASE + 1000)).alias("expires")
    )
    return bids(spark, [(1, 1, 5, 900), (1, 2, 9, 1000), (1, 3, 7, 1500)]), a


@pytest.mark.parametrize("salts", [1, 4])
def test_expiry(spark, salts):
    b, a = expiring(spark)
    assert tuples(joins.bid_auction_join(b, a, salts=salts), "price") == [(5,)]
    assert tuples(joins.bid_auction_join(b, a, rule=joins.IN_LIFETIME, salts=salts), "price") == [(5,), (9,)]
    assert tuples(joins.rejected_bids(b, a, salts=salts), "price") == [(7,), (9,)]
    assert tuples(joins.bid_auction_join(b, a, max_lifetime="950 milliseconds", salts=salts), "price") == [(5,)]
    assert tuples(joins.bid_auction_join(b, a, max_lifetime="500 milliseconds", salts=salts), "price") == []


def test_live_and_closed(spark):
    _, a = expiring(spark)
    for as_of, closed, live in (("2024-01-01 00:00:00", 0, 1), ("2024-01-01 00:00:01", 0, 0), ("2024-01-01 00:00:02", 1, 0)):
        assert project.closed_auctions(a, as_of).count() == closed
        assert project.live_auctions(a, as_of).count() == live


def sellers(spark):
    p = persons(spark, [(i, i % 4, f"p{i % 4}", "x", "OR") for i in range(60)])
    a = auctions(spark, [(i, i, i % 4, 10) for i in range(90)])
    p = p.withColumn("ts", F.timestamp_millis(F.lit(BASE) + F.col("seq") * 7300))
    a = a.withColumn("ts", F.timestamp_millis(F.lit(BASE) + F.col("seq") * 4100)).withColumn("reserve", F.col("seq"))
    return p, a


@pytest.mark.parametrize("salts", [1, 3])
def test_new_sellers(spark, salts):
    p, a = sellers(spark)
    want = sorted(
        (i % 4, f"p{i % 4}", j) for i in range(60) for j in range(90)
        if i % 4 == j % 4 and 7300 * i // 10_000 == 4100 * j // 10_000
    )
    assert want and tuples(joins.new_sellers(p, a, salts=salts), "id", "name", "reserve") == want


def test_sellers_within_a_gap(spark):
    p, a = sellers(spark)
    want = sorted(
        (i % 4, j) for i in range(60) for j in range(90) if i % 4 == j % 4 and abs(7300 * i - 4100 * j) < 20_000
    )
    assert tuples(joins.sellers_within(p, a, "20 seconds"), "id", "reserve") == want


def test_group_maximum(spark):
    rows = spark.createDataFrame([(i % 3, i // 6) for i in range(36)], "k long, v long")
    assert tuples(joins.at_group_max(rows, ["k"], "v"), "k", "v") == sorted([(k, 5) for k in range(3)] * 2)
    assert tuples(joins.at_group_max(rows, ["k"], "v", salts=4), "k", "v") == sorted([(k, 5) for k in range(3)] * 2)


def test_buffered_join_takes_no_null_keys(spark):
    b = spark.createDataFrame([(None, 1, 1, 10, None), (1, 3, 1, 20, None)], "auction long, seq long, bidder long, price long, ts timestamp")
    a = spark.createDataFrame([(None, 2, 7, None, None), (1, 4, 7, None, None)], "id long, seq long, seller long, ts timestamp, expires timestamp")
    for hot_rows in (None, 1 << 22, 1):
        assert tuples(asof.buffered_join(b, a, hot_rows=hot_rows), "auction", "price") == [(1, 20)]
