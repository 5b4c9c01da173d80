"""The chunked scan against a plain loop: any chunk width gives the same result."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelspark.operators.scan import repeat_rows, running_before, split_keys


def expected(rows):
    """(key, pos, price, id) rows -> id: (count, sum, best) of the rows before."""
    out, state = {}, {}
    for key, pos, price, id_ in sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1, r[3])):
        n, total, best = state.get(key, (None, None, None))
        out[id_] = (n, total, best)
        if price is None:
            state[key] = ((n or 0) + 1, total, best)
        else:
            state[key] = ((n or 0) + 1, (total or 0) + price, price if best is None else max(best, price))
    return out


def scanned(spark, rows, order, keys=("k",), hot_rows=None):
    df = spark.createDataFrame(rows, "k long, pos long, price long, id long")
    measures = {"n": ("sum", F.lit(1)), "total": ("sum", "price"), "best": ("max", "price")}
    out = running_before(df, list(keys), order, measures, hot_rows).collect()
    assert len(out) == len(rows)
    return {r.id: (r.n, r.total, r.best) for r in out}


def random_rows(n, keys, seed):
    rng = random.Random(seed)
    # a third of the rows has one key, and a third of those one position
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, keys)
        pos = 7 if rng.random() < 0.34 else rng.randrange(60)
        rows.append((key, pos, rng.randrange(300), i))
    return rows


@pytest.mark.parametrize("order", [
    ["pos", "price", "id"],
    [("pos", 8), "price", "id"],
    [("pos", 8), ("price", 16), "id"],
    [("pos", 1), ("price", 1), ("id", 4)],
    [("pos", 1000), ("price", 1000), "id"],
])
@pytest.mark.parametrize("hot_rows", [None, 0, 330, 10_000])
def test_any_chunks(spark, order, hot_rows):
    # keys have about 510 or 330 rows: all, some or none are hot
    rows = random_rows(1500, 4, 1)
    assert scanned(spark, rows, order, hot_rows=hot_rows) == expected(rows)


def test_weights_make_keys_hot(spark):
    df = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (1, 1, 1)], "k long, pos long, copies long")
    cold, hot = split_keys(df, ["k"], 5, F.col("copies"))
    assert (cold.count(), hot.count()) == (1, 2)
    cold, hot = split_keys(df, ["k"], 5)
    assert (cold.count(), hot.count()) == (3, 0)


def test_keys_may_be_missing_from_the_hot_list(spark):
    df = spark.createDataFrame([(None, 1), (0, 1)], "k long, pos long")
    cold, hot = split_keys(df, ["k"], 100)
    assert (cold.count(), hot.count()) == (2, 0)


def test_without_key(spark):
    rows = [(0, pos, price, id_) for _, pos, price, id_ in random_rows(800, 2, 2)]
    assert scanned(spark, rows, [("pos", 4), ("price", 32), "id"], keys=()) == expected(rows)


def test_chunks_without_inputs(spark):
    # whole chunks hold only nulls; what came before must get through them
    rows = [(0, pos, 5 if pos < 10 else None, pos) for pos in range(60)]
    assert scanned(spark, rows, [("pos", 8), "id"]) == expected(rows)


def test_negative_positions(spark):
    rows = [(0, pos, pos % 7, pos + 100) for pos in range(-50, 50)]
    assert scanned(spark, rows, [("pos", 8), "id"]) == expected(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 50)), min_size=1, max_size=60),
    st.integers(1, 50), st.integers(1, 60),
)
def test_any_input(spark, triples, pos_width, price_width):
    rows = [(k, pos, price, i) for i, (k, pos, price) in enumerate(triples)]
    assert scanned(spark, rows, [("pos", pos_width), ("price", price_width), "id"]) == expected(rows)


def test_times_are_chunked(spark):
    df = spark.range(200).select(
        F.lit(0).alias("k"), "id", (F.timestamp_millis(F.col("id") * 1000)).cast("timestamp_ntz").alias("ts")
    )
    out = running_before(df, ["k"], [("ts", "10 seconds")], {"n": ("sum", F.lit(1)), "last": ("max", "id")}, None)
    out = out.collect()
    assert all((r.n or 0) == r.id and (r.last if r.id else -1) == r.id - 1 for r in out)


def test_repeat_rows_in_blocks(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 17), (4, 4)], "a long, c long")
    got = sorted((r.a, r.i) for r in repeat_rows(df, "c", "i", block=4).collect())
    assert got == [(a, i) for a, c in [(1, 5), (2, 1), (3, 17), (4, 4)] for i in range(1, c + 1)]
