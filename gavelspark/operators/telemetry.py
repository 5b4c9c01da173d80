"""Analysis of the runs themselves: recovery, throughput, backlog, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.functions.intervals import micros
from gavelspark.functions.scalar import log_time, micros_between, ratio, seconds_between
from gavelspark.operators.scan import running_before
from gavelspark.operators.windows import windowed

# The log messages, file names and cells that are looked for.
RESTORE_PATTERN = r"Restoring job .* from Checkpoint"
RUNNING_PATTERN = r"switched from INITIALIZING to RUNNING"
SWEEP_FILE_PATTERN = r"paral_(\d+)_interval_(\d+)\.log"
PARTITION_PATTERN = r"partition=(\d+)\): (\d+)"


def marker_span(rows: DataFrame, key: str, order: str, ts: str, start: Column, end: Column) -> DataFrame:
    """Per key the time from the last ``start`` row to the last ``end`` row; null if one is missing."""
    last = lambda flag: F.max(F.when(flag, F.struct(order, ts)))
    marks = rows.groupBy(key).agg(last(start).alias("_start"), last(end).alias("_end"))
    return marks.select(key, micros_between(F.col("_start")[ts], F.col("_end")[ts]).alias("span_micros"))


def marker_offsets(rows: DataFrame, key: str, order: str, ts: str, start: Column, end: Column) -> DataFrame:
    """Seconds from the last ``start`` row of a key to each of its ``end`` rows.

    Offsets of rows before the start are negative and marked as not valid.
    """
    starts = rows.filter(start).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(order, ts)).alias("_start"))
    ends = rows.filter(end).join(starts, F.col(key) == F.col("_key"))
    offset = seconds_between(F.col("_start")[ts], F.col(ts))
    return ends.select(key, order, offset.alias("offset_seconds")).withColumn("valid", F.col("offset_seconds") >= 0)


def _timed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("ts", log_time("value"))


def recovery_duration(lines: DataFrame) -> DataFrame:
    """Per log file the time from the last restore to the last task that runs."""
    value = F.col("value")
    return marker_span(_timed(lines), "file", "line", "ts", value.rlike(RESTORE_PATTERN), value.rlike(RUNNING_PATTERN))


def transition_offsets(lines: DataFrame) -> DataFrame:
    """Per log file seconds from the last restore to each task that runs."""
    value = F.col("value")
    return marker_offsets(_timed(lines), "file", "line", "ts", value.rlike(RESTORE_PATTERN), value.rlike(RUNNING_PATTERN))


def sweep_summary(durations: DataFrame) -> DataFrame:
    """Recovery times by the parallelism and interval in the file name."""
    part = lambda group: F.regexp_extract("file", SWEEP_FILE_PATTERN, group).try_cast("int")
    named = durations.filter(F.col("file").rlike(SWEEP_FILE_PATTERN))
    return named.groupBy(part(1).alias("parallelism"), part(2).alias("interval_ms")).agg(
        F.count("*").alias("runs"),
        F.count("span_micros").alias("recovered"),
        ratio(F.sum("span_micros"), F.count("span_micros")).alias("avg_micros"),
        F.max("span_micros").alias("max_micros"),
    )


def throughput_samples(
    messages: DataFrame, width: str = "2 seconds", ts: str = "ts", keys: Sequence[str] = ()
) -> DataFrame:
    """Messages and messages per second in fixed intervals."""
    counts = windowed(messages, [F.count("*").alias("messages")], width, keys=keys, ts=ts)
    return counts.withColumn("per_second", F.col("messages") * 1_000_000.0 / micros(width))


def consumer_lag(messages: DataFrame, partition: str = "partition", width: str = "2 seconds", ts: str = "ts") -> DataFrame:
    """Per sample and partition: messages read so far and messages still unread."""
    samples = windowed(messages, [F.count("*").alias("_read")], width, keys=[partition], ts=ts)
    ends = samples.groupBy(F.col(partition).alias("_partition")).agg(F.sum("_read").alias("end_offset"))
    so_far = running_before(samples, [partition], [("window_start", "1 day")], {"_before": ("sum", "_read")})
    position = F.coalesce("_before", F.lit(0)) + F.col("_read")
    placed = so_far.withColumn("position", position).join(ends, F.col(partition) == F.col("_partition"))
    return placed.select(
        "window_start", "window_end", partition, "position", "end_offset",
        (F.col("end_offset") - F.col("position")).alias("unread"),
    )


def parse_latency(lines: DataFrame, value: str = "value") -> DataFrame:
    """``%latency%<ms>%<now>%<marked>%<source>%<sink>`` lines as columns; others are dropped."""
    parts = F.split(value, "%")
    number = lambda i: F.get(F.col("_parts"), i).try_cast("long")
    marked = lines.select(parts.alias("_parts")).filter(F.get("_parts", 1) == "latency")
    return marked.select(
        number(2).alias("latency_ms"), number(3).alias("now_ms"), number(4).alias("marked_ms"),
        number(5).alias("source_subtask"), number(6).alias("sink_subtask"),
    ).filter(F.col("latency_ms").isNotNull())


def latency_stats(records: DataFrame, keys: Sequence[str] = ("source_subtask", "sink_subtask")) -> DataFrame:
    """Count, median, 95th percentile and maximum of the latencies per group.

    Equal latencies are counted first, so a group costs its distinct milliseconds.
    """
    counted = records.groupBy(*keys, "latency_ms").agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("records"),
        F.percentile("latency_ms", F.lit(0.5), F.col("_n")).alias("median_ms"),
        F.percentile("latency_ms", F.lit(0.95), F.col("_n")).alias("p95_ms"),
        F.max("latency_ms").alias("max_ms"),
    )


def parse_lag_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of the sample file: time, rate and, per partition, the position and the unread messages.

    Map cells hold commas, so cells are found by their braces.
    """
    cells = F.regexp_extract_all(F.col(value), F.lit(r"\{([^}]*)\}"), F.lit(1))
    pairs = lambda cell: F.map_from_arrays(
        F.transform(F.regexp_extract_all(cell, F.lit(PARTITION_PATTERN), F.lit(1)), lambda x: x.cast("int")),
        F.transform(F.regexp_extract_all(cell, F.lit(PARTITION_PATTERN), F.lit(2)), lambda x: x.cast("long")),
    )
    data = lines.filter(F.col(value).rlike(r"^\d+:\d+:\d+,")).withColumn("_cells", cells)
    return data.select(
        F.split_part(F.col(value), F.lit(","), F.lit(1)).alias("sampled_at"),
        F.split_part(F.col(value), F.lit(","), F.lit(2)).cast("double").alias("per_second"),
        pairs(F.get("_cells", 0)).alias("position"),
        pairs(F.get("_cells", 1)).alias("unread"),
    )


def diff_histogram(numbers: DataFrame, value: str = "value") -> DataFrame:
    """How often each difference occurs; negative ones are not valid."""
    counts = numbers.groupBy(F.col(value).alias("diff")).agg(F.count("*").alias("n"))
    return counts.withColumn("valid", F.col("diff") >= 0)


PROGRESS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("runId", T.StringType()),
    T.StructField("batchId", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("numInputRows", T.LongType()),
    T.StructField("durationMs", T.MapType(T.StringType(), T.LongType())),
    T.StructField("stateOperators", T.ArrayType(T.StructType([
        T.StructField("numRowsTotal", T.LongType()),
        T.StructField("numRowsDroppedByWatermark", T.LongType()),
    ]))),
    T.StructField("observedMetrics", T.MapType(T.StringType(), T.StructType([
        T.StructField("rows", T.LongType()),
        T.StructField("mean_ms", T.DoubleType()),
        T.StructField("max_ms", T.LongType()),
    ]))),
])


def parse_progress(lines: DataFrame, value: str = "value") -> DataFrame:
    """Progress reports of streams, one JSON object per line."""
    return lines.select(F.from_json(F.col(value), PROGRESS).alias("p")).select("p.*")


def progress_table(reports: DataFrame) -> DataFrame:
    """Per stream: batches, rows, median and longest batch, commit time, late rows, restarts."""
    took = F.col("durationMs")["triggerExecution"]
    dropped = F.aggregate(
        F.coalesce("stateOperators", F.array().cast(PROGRESS["stateOperators"].dataType)),
        F.lit(0).cast("long"),
        lambda total, op: total + F.coalesce(op["numRowsDroppedByWatermark"], F.lit(0)),
    )
    return reports.groupBy("id").agg(
        F.count("*").alias("batches"),
        F.sum("numInputRows").alias("input_rows"),
        F.median(took).alias("median_batch_ms"),
        F.max(took).alias("max_batch_ms"),
        F.max(F.col("durationMs")["walCommit"]).alias("max_commit_ms"),
        F.sum(dropped).alias("late_rows"),
        (F.count_distinct("runId") - 1).alias("restarts"),
    )


def observed_table(reports: DataFrame, metrics: str) -> DataFrame:
    """Per stream: rows that were observed under the name ``metrics``, their mean and longest delay."""
    seen = F.col("observedMetrics")[metrics]
    return reports.filter(seen.isNotNull()).groupBy("id").agg(
        F.sum(seen["rows"]).alias("observed_rows"),
        ratio(F.sum(seen["mean_ms"] * seen["rows"]), F.sum(seen["rows"])).alias("mean_ms"),
        F.max(seen["max_ms"]).alias("max_ms"),
    )
