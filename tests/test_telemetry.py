from __future__ import annotations

import json

from fixtures import bids, tuples
from pyspark.sql import functions as F

from gavelspark.operators import telemetry
from gavelspark.sources.files import parse_int_lines, read_log_lines

LOG = """2024-04-20 09:59:50,000 INFO  Task (1/1) switched from INITIALIZING to RUNNING.
2024-04-20 10:00:00,123 INFO  Restoring job 0 from Checkpoint 7 @ 1 for 0
2024-04-20 10:00:01,000 INFO  Source (1/2) switched from INITIALIZING to RUNNING.
not a log line
2024-04-20 10:01:02,500 INFO  Source (2/2) switched from INITIALIZING to RUNNING.
2024-04-20 10:01:03,000 INFO  done
"""


def write_logs(folder):
    with open(f"{folder}/paral_7_interval_5000.log", "w") as f:
        f.write(LOG)
    with open(f"{folder}/paral_8_interval_5000.log", "w") as f:
        f.write(LOG.replace("Restoring", "Starting"))
    with open(f"{folder}/other.txt", "w") as f:
        f.write(LOG)


def test_recovery_of_log_files(spark, folder):
    write_logs(folder)
    lines = read_log_lines(spark, folder)
    spans = telemetry.recovery_duration(lines)
    assert dict(tuples(spans, "file", "span_micros")) == {
        "paral_7_interval_5000.log": 62_377_000, "paral_8_interval_5000.log": None,
    }
    offsets = telemetry.transition_offsets(lines)
    assert tuples(offsets, "offset_seconds", "valid") == [(-10, False), (1, True), (62, True)]
    sweep = telemetry.sweep_summary(spans)
    assert tuples(sweep, "parallelism", "interval_ms", "runs", "recovered", "max_micros") == [
        (7, 5000, 1, 1, 62_377_000), (8, 5000, 1, 0, None),
    ]


def test_last_line_of_equal_times(spark):
    rows = [("f", 1, "2024-04-20 10:00:00,000 Restoring job a from Checkpoint 1"),
            ("f", 2, "2024-04-20 10:00:05,000 switched from INITIALIZING to RUNNING"),
            ("f", 3, "2024-04-20 10:00:02,000 Restoring job a from Checkpoint 2")]
    lines = spark.createDataFrame(rows, "file string, line long, value string")
    assert telemetry.recovery_duration(lines).first().span_micros == 3_000_000


def test_throughput(spark):
    df = bids(spark, [(1, i, 1, 300 * i) for i in range(20)])
    got = tuples(telemetry.throughput_samples(df), "messages", "per_second")
    assert got == [(6, 3.0), (7, 3.5), (7, 3.5)]


def test_lag(spark):
    df = bids(spark, [(i % 2, i, 1, 1000 * i) for i in range(8)]).withColumn("partition", F.col("auction").cast("int"))
    got = telemetry.consumer_lag(df)
    assert tuples(got, "partition", "position", "end_offset", "unread") == [
        (p, n, 4, 4 - n) for p in (0, 1) for n in (1, 2, 3, 4)
    ]


def test_latency(spark):
    lines = [f"%latency%{ms}%{1000 + ms}%1000%0%{sink}" for sink, values in ((0, [1, 2, 3]), (1, [10])) for ms in values]
    df = spark.createDataFrame([(v,) for v in [*lines, "WARN something", "%other%1%2%3%4%5"]], "value string")
    stats = telemetry.latency_stats(telemetry.parse_latency(df))
    assert tuples(stats, "source_subtask", "sink_subtask", "records", "median_ms", "max_ms") == [
        (0, 0, 3, 2.0, 3), (0, 1, 1, 10.0, 10),
    ]


def test_lag_samples(spark):
    lines = [
        "Timestamp,Messages Per Second,Current Offsets,Unread Messages",
        "09:15:02,120.25,{TopicPartition(topic='a', partition=0): 4001},{TopicPartition(topic='a', partition=0): 88}",
        "09:15:04,1.5,{TopicPartition(topic='a', partition=0): 1, TopicPartition(topic='a', partition=1): 2},"
        "{TopicPartition(topic='a', partition=0): 3, TopicPartition(topic='a', partition=1): 4}",
    ]
    got = telemetry.parse_lag_samples(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [
        ("09:15:02", 120.25, {0: 4001}, {0: 88}), ("09:15:04", 1.5, {0: 1, 1: 2}, {0: 3, 1: 4}),
    ]


def test_differences(spark):
    lines = spark.createDataFrame([(v,) for v in ["-120", "-120", "0", "1", "1", "1", "x"]], "value string")
    assert tuples(telemetry.diff_histogram(parse_int_lines(lines)), "diff", "n", "valid") == [
        (-120, 2, False), (0, 1, True), (1, 3, True),
    ]


def test_progress(spark):
    def report(run, batch, took, late):
        return json.dumps({
            "id": "q", "runId": run, "batchId": batch, "timestamp": "2024-01-01T00:00:00.000Z", "numInputRows": 10,
            "durationMs": {"triggerExecution": took, "walCommit": 5}, "eventTime": {},
            "stateOperators": [{"numRowsTotal": 3, "numRowsDroppedByWatermark": late}],
        })

    lines = [report("a", 0, 100, 0), report("a", 1, 300, 2), report("b", 2, 200, 1)]
    reports = telemetry.parse_progress(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert telemetry.progress_table(reports).first().asDict() == {
        "id": "q", "batches": 3, "input_rows": 30, "median_batch_ms": 200.0, "max_batch_ms": 300, "max_commit_ms": 5,
        "late_rows": 3, "restarts": 1,
    }
