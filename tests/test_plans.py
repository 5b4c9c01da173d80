"""What must hold for the plans whatever the size of the data."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from gavelspark.operators import aggregates, asof
from gavelspark.operators.scan import chunk_of
from gavelspark.plans import PLANS
from gavelspark.sources import tables

BATCH = sorted(name for name in PLANS if not name.startswith("stream_"))
# these read a topic of files, which is a data source in Python
TOPICS = {name for name in BATCH if PLANS[name].__module__ == "gavelspark.plans.live"}


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_joins_and_no_python(spark, name):
    plan = PLANS[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert name in TOPICS or "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name, table, columns", [
    ("q1_currency", "lineitem", {"l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate"}),
    ("q7_highest_bid_per_auction", "events", {"event_id", "ts", "user_id", "value"}),
    ("q5_bid_counts", "events", {"ts", "user_id"}),
    ("state_filter", "nation", {"n_nationkey", "n_name"}),
])
def test_scans_read_only_what_is_used(spark, name, table, columns):
    plan = final_plan(PLANS[name](spark, SMALL))
    reads = re.findall(rf"FileScan parquet \[([^\]]*)\].*?{table}\.parquet", plan)
    assert reads and all({c.split("#")[0] for c in read.split(",")} == columns for read in reads)


def test_filters_reach_the_scan(spark):
    early = PLANS["state_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in early
    live = PLANS["q3_pending_join"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in live


@pytest.mark.parametrize("name, scans", [
    ("record_highs_category", 2), ("running_avg", 2), ("q5_hot_items", 1),
])
def test_inputs_are_computed_once(spark, name, scans):
    plan = final_plan(PLANS[name](spark, SMALL))
    assert plan.count("FileScan parquet") == scans and "ReusedExchange" in plan


def window_keys(plan: str) -> set[tuple[str, ...]]:
    specs = re.findall(r"windowspecdefinition\(([^)]*?), (?:_carried#\d+|false) DESC", plan)
    return {tuple(c.split("#")[0] for c in spec.split(", ")) for spec in specs}


def test_hot_keys_are_ordered_by_chunk(spark):
    """A window over the bare key of hot rows may only run over the sums of its chunks."""
    plan = final_plan(PLANS["running_avg"](spark, SMALL))
    assert window_keys(plan) == {
        ("category", "_chunk0", "ts", "_chunk1"), ("category", "_chunk0", "ts"), ("category", "_chunk0"), ("category",),
    }
    bids = tables.event_bids(spark, SMALL)
    plan = final_plan(aggregates.running_average(bids, "auction", [("seq", 16)], hot_rows=40))
    assert window_keys(plan) == {("auction", "_chunk0"), ("auction",)}


def test_nothing_runs_for_hot_keys_where_there_are_none(spark):
    plan = final_plan(PLANS["running_avg_by_arrival"](spark, SMALL))
    assert "_chunk" not in plan and window_keys(plan) == set()


def test_late_rows_are_found_without_one_big_task(spark):
    plan = final_plan(PLANS["late_flags"](spark, SMALL))
    # the one window without keys runs over the sums of the widest chunks
    wide = ("_wide1048576", "_wide1024")
    assert window_keys(plan) >= {wide[:1], wide, (*wide, "_chunk0"), (*wide, "_chunk0", "arrival")}
    assert plan.count("SinglePartition") == 1


def test_sparse_orders_leave_little_for_the_last_window(spark):
    """Arrival numbers far apart: the window without keys gets few rows all the same."""
    rows = spark.range(4000).select((F.col("id") * (1 << 26)).alias("seq"), F.timestamp_millis("id").alias("ts"))
    plan = asof.with_arrival_watermark(rows, "1 second")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[0].count("SinglePartition") == 1
    levels = rows.select(chunk_of(rows, "seq", 1 << 40).alias("top"), chunk_of(rows, "seq", 1 << 20).alias("chunk"))
    assert levels.select("chunk").distinct().count() == 4000 and levels.select("top").distinct().count() == 1
    want = rows.agg(F.max("ts")).first()[0]
    assert plan.agg(F.max("watermark")).first()[0] < want and plan.filter("watermark is null").count() == 1


def test_encoded_records_are_encoded_once(spark):
    plan = final_plan(PLANS["bid_codec"](spark, SMALL))
    assert plan.count("to_json") == 1 or plan.count("invoke(") == 1 or plan.count("StructsToJson") <= 1


def test_sliding_windows_are_counted_by_pane_first(spark):
    plan = final_plan(PLANS["q5_bid_counts"](spark, SMALL))
    # rows meet one partial count before the first exchange; windows are fanned out after the last one
    last_exchange = plan.index("Exchange hashpartitioning")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("_start#") < last_exchange
    assert "Expand" not in plan


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "20",
}


def test_hot_join_keys_are_split(spark):
    """A third of the bids on one auction: its partition is split, also under a grouping by auction."""
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        number = F.col("id")
        hot = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
        bids = spark.range(0, 60_000, 1, 8).select(
            F.when(hot, 1).otherwise(number % 500).cast("long").alias("auction"), number.alias("bidder"),
            (number * 7919 % 100_003).alias("price"), F.timestamp_millis(number).alias("ts"),
        )
        auctions = spark.range(500).select(
            number.alias("id"), (number % 5).alias("category"), F.timestamp_millis(number * 0 + 10**9).alias("expires")
        )
        finals = aggregates.final_prices(bids, auctions)
        plan = final_plan(finals)
        assert "SortMergeJoin(skew=true)" in plan and "BroadcastHashJoin" not in plan
        best = bids.groupBy("auction").agg(F.max("price").alias("final"))
        assert finals.select("auction", "final").exceptAll(best).count() == 0
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
