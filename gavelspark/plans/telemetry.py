"""Queries on run telemetry. The events table stands in for logs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions.scalar import clock_time
from gavelspark.operators import samples, telemetry
from gavelspark.plans.aggregates import bucket
from gavelspark.plans.registry import query
from gavelspark.schema import epoch_millis
from gavelspark.sources import tables
from gavelspark.sources.files import parse_int_lines


@query("marker_span", """
    SELECT user_id,
           epoch_us(max_by(ts, event_id) FILTER (event_type = 'view'))
           - epoch_us(max_by(ts, event_id) FILTER (event_type = 'error')) AS span_micros
    FROM events GROUP BY user_id""")
def marker_span(spark, sf_dir):
    kind = F.col("event_type")
    return telemetry.marker_span(
        tables.events(spark, sf_dir), "user_id", "event_id", "ts", kind == "error", kind == "view"
    )


def log_lines(spark, sf_dir):
    """Users as log files: views are tasks that start to run; errors are restores, but not in every file."""
    kind = F.col("event_type")
    message = (
        F.when((kind == "error") & (F.col("user_id") % 10 > 0), "INFO Restoring job 0 from Checkpoint 7")
        .when(kind == "view", "INFO Source (1/1) switched from INITIALIZING to RUNNING.")
        .otherwise(F.concat(F.lit("INFO "), F.col("props")))
    )
    return tables.events(spark, sf_dir).select(
        F.concat(
            F.lit("paral_"), (F.col("user_id") % 6 + 7).cast("string"), F.lit("_interval_"),
            (1000 * (F.col("user_id") + 1)).cast("string"), F.lit(".log"),
        ).alias("file"),
        F.col("event_id").alias("line"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), message).alias("value"),
    )


_LOG = """
    SELECT 'paral_' || (user_id % 6 + 7) || '_interval_' || 1000 * (user_id + 1) || '.log' AS file,
           event_id AS line, event_type = 'view' AS running, event_type = 'error' AND user_id % 10 > 0 AS restore,
           date_trunc('millisecond', ts) AS ts
    FROM events"""
SPANS_SQL = f"""
    SELECT file, epoch_us(max_by(ts, line) FILTER (running)) - epoch_us(max_by(ts, line) FILTER (restore)) AS span_micros
    FROM ({_LOG}) GROUP BY file"""


@query("recovery_duration", SPANS_SQL)
def recovery_duration(spark, sf_dir):
    return telemetry.recovery_duration(log_lines(spark, sf_dir))


@query("sweep_summary", f"""
    SELECT CAST(regexp_extract(file, 'paral_(\\d+)_', 1) AS INTEGER) AS parallelism,
           CAST(regexp_extract(file, 'interval_(\\d+)', 1) AS INTEGER) AS interval_ms,
           count(*) AS runs, count(span_micros) AS recovered,
           CAST(sum(span_micros) AS DOUBLE) / nullif(count(span_micros), 0) AS avg_micros,
           max(span_micros) AS max_micros
    FROM ({SPANS_SQL}) GROUP BY ALL""")
def sweep_summary(spark, sf_dir):
    return telemetry.sweep_summary(telemetry.recovery_duration(log_lines(spark, sf_dir)))


@query("transition_offsets", f"""
    WITH log AS ({_LOG}),
    start AS (SELECT file, max_by(ts, line) AS t0 FROM log WHERE restore GROUP BY file)
    SELECT l.file, l.line, CAST(epoch(date_trunc('second', l.ts)) AS BIGINT)
                           - CAST(epoch(date_trunc('second', s.t0)) AS BIGINT) AS offset_seconds,
           CAST(epoch(date_trunc('second', l.ts)) AS BIGINT)
           >= CAST(epoch(date_trunc('second', s.t0)) AS BIGINT) AS valid
    FROM log l JOIN start s USING (file) WHERE l.running""")
def transition_offsets(spark, sf_dir):
    return telemetry.transition_offsets(log_lines(spark, sf_dir))


@query("throughput_samples", f"""
    SELECT {bucket('2 SECOND')} AS window_start, {bucket('2 SECOND')} + INTERVAL 2 SECOND AS window_end,
           count(*) AS messages, count(*) / 2.0::DOUBLE AS per_second FROM events GROUP BY ALL""")
def throughput_samples(spark, sf_dir):
    return telemetry.throughput_samples(tables.events(spark, sf_dir))


@query("lag_samples", f"""
    WITH s AS (SELECT CAST(user_id % 4 AS INTEGER) AS "partition", {bucket('1 HOUR')} AS window_start, count(*) AS n
               FROM events GROUP BY ALL)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, "partition",
           CAST(sum(n) OVER w AS BIGINT) AS position,
           CAST(sum(n) OVER (PARTITION BY "partition") AS BIGINT) AS end_offset,
           CAST(sum(n) OVER (PARTITION BY "partition") - sum(n) OVER w AS BIGINT) AS unread
    FROM s WINDOW w AS (PARTITION BY "partition" ORDER BY window_start)""")
def lag_samples(spark, sf_dir):
    messages = tables.events(spark, sf_dir).withColumn("partition", (F.col("user_id") % 4).cast("int"))
    return telemetry.consumer_lag(messages, width="1 hour")


@query("latency_stats", """
    SELECT user_id % 3 AS source_subtask, user_id % 5 AS sink_subtask, count(*) AS records,
           quantile_cont(event_id % 1000, 0.5) AS median_ms, quantile_cont(event_id % 1000, 0.95) AS p95_ms,
           max(event_id % 1000) AS max_ms
    FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def latency_stats(spark, sf_dir):
    marked = epoch_millis("ts")
    took = F.col("event_id") % 1000
    line = F.when(F.col("event_type") == "error", F.lit("WARN no marker")).otherwise(
        F.concat_ws("%", F.lit(""), F.lit("latency"), took, marked + took, marked, F.col("user_id") % 3, F.col("user_id") % 5)
    )
    return telemetry.latency_stats(telemetry.parse_latency(tables.events(spark, sf_dir).select(line.alias("value"))))


@query("lag_csv_parse", """
    SELECT strftime(ts, '%H:%M:%S') AS sampled_at, value AS per_second,
           CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS position, 2 * event_id AS unread
    FROM events WHERE event_type <> 'error'""")
def lag_csv_parse(spark, sf_dir):
    cell = lambda offset: F.concat(
        F.lit("{TopicPartition(topic='t', partition="), (F.col("user_id") % 4).cast("string"), F.lit("): "),
        offset.cast("string"), F.lit("}"),
    )
    line = F.when(F.col("event_type") == "error", F.lit("Timestamp,Messages Per Second,Current Offsets,Unread Messages"))
    line = line.otherwise(
        F.concat_ws(",", clock_time("ts"), F.col("value"), cell(F.col("event_id")), cell(2 * F.col("event_id")))
    )
    samples = telemetry.parse_lag_samples(tables.events(spark, sf_dir).select(line.alias("value")))
    return samples.select("sampled_at", "per_second", "unread", F.explode("position").alias("partition", "position")).select(
        "sampled_at", "per_second", "partition", "position", F.col("unread")[F.col("partition")].alias("unread")
    )


@query("diff_histogram", """
    SELECT CAST(event_id % 97 - user_id AS BIGINT) AS diff, count(*) AS n, event_id % 97 - user_id >= 0 AS valid
    FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def diff_histogram(spark, sf_dir):
    number = (F.col("event_id") % 97 - F.col("user_id")).cast("string")
    line = F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.concat(F.lit(" "), number, F.lit(" ")))
    return telemetry.diff_histogram(parse_int_lines(tables.events(spark, sf_dir).select(line.alias("value"))))


@query("progress_table", """
    SELECT event_type AS id, count(*) AS batches, CAST(sum(event_id) AS BIGINT) AS input_rows,
           median(event_id % 1000) AS median_batch_ms, max(event_id % 1000) AS max_batch_ms,
           max(event_id % 100) AS max_commit_ms, CAST(sum(event_id % 3 + event_id % 5) AS BIGINT) AS late_rows,
           count(DISTINCT user_id % 7) - 1 AS restarts
    FROM events GROUP BY event_type""")
def progress_table(spark, sf_dir):
    n = F.col("event_id")
    report = F.to_json(F.struct(
        F.col("event_type").alias("id"), (F.col("user_id") % 7).cast("string").alias("runId"), n.alias("batchId"),
        n.alias("numInputRows"),
        F.struct((n % 1000).alias("triggerExecution"), (n % 100).alias("walCommit")).alias("durationMs"),
        F.array(
            F.struct((n % 3).alias("numRowsDroppedByWatermark")), F.struct((n % 5).alias("numRowsDroppedByWatermark"))
        ).alias("stateOperators"),
    ))
    lines = tables.events(spark, sf_dir).select(report.alias("value"))
    return telemetry.progress_table(telemetry.parse_progress(lines))


def ragged_sql(width: str, key: str | None = None) -> str:
    """Sample after sample, from the first message on."""
    part = f"{key} AS part" if key else "0 AS part"
    return f"""
    WITH RECURSIVE m AS (SELECT {part}, ts FROM events),
    b AS (SELECT part, min(ts) AS began FROM m GROUP BY part
          UNION ALL
          SELECT b.part, min(m.ts) FROM b JOIN m ON m.part = b.part AND m.ts >= b.began + INTERVAL {width} GROUP BY b.part, b.began),
    s AS (SELECT part, began, lead(began) OVER (PARTITION BY part ORDER BY began) AS ended FROM b)
    SELECT {'s.part AS "partition", ' if key else ''}began, ended, count(*) AS messages,
           count(*) * 1000000.0::DOUBLE / (epoch_us(ended) - epoch_us(began)) AS per_second
    FROM s JOIN m ON m.part = s.part AND m.ts >= s.began AND m.ts < s.ended WHERE ended IS NOT NULL GROUP BY s.part, began, ended"""


@query("ragged_samples", ragged_sql("30 MINUTE"))
def ragged_samples(spark, sf_dir):
    return samples.ragged_samples(tables.events(spark, sf_dir), "30 minutes")


@query("ragged_samples_by_partition", ragged_sql("2 HOUR", "CAST(user_id % 4 AS INTEGER)"))
def ragged_samples_by_partition(spark, sf_dir):
    messages = tables.events(spark, sf_dir).withColumn("partition", (F.col("user_id") % 4).cast("int"))
    return samples.ragged_samples(messages, "2 hours", keys=["partition"])
