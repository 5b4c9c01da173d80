"""Text, CSV and file-backed streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounded_stream(rows: DataFrame, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A finished frame as a stream: written out once, then read file by file."""
    rows.write.mode("append").parquet(folder)
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def dump_messages(messages: DataFrame, folder: str) -> None:
    """Message values as text, one per line."""
    messages.select(F.col("value").cast("string").alias("value")).write.mode("append").text(folder)


def dump_log_lines(lines: DataFrame, folder: str) -> None:
    """Logs (file, line, value) packed into a few files, each log in one of them, its lines in order.

    A line begins with the name of its log and a tab. A file for each log would cost the driver most of the time.
    """
    dealt = lines.repartition("file").sortWithinPartitions("file", "line")
    empty = F.lit("")
    dump_messages(dealt.select(F.concat(F.coalesce("file", empty), F.lit("\t"), F.coalesce("value", empty)).alias("value")), folder)


def read_log_lines(spark: SparkSession, folder: str, pattern: str = "*.log", named: bool = False) -> DataFrame:
    """The lines (file, line, value) of the logs of a folder; ``line`` grows within a file.

    Logs are files, or folders ``file=...`` of one file; ``named`` ones are packed (``dump_log_lines``), without
    a name null. Lines are ordered by the file's block that they were read in, then by their place in it.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    name, value = F.col("file") if "file" in lines.columns else F.col("_metadata.file_name"), F.col("value")
    if named:
        tab = F.instr("value", "\t")
        name, value = F.nullif(F.substr(F.col("value"), F.lit(1), tab - 1), F.lit("")), F.substr(F.col("value"), tab + 1)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    return lines.select(name.alias("file"), (F.col("_metadata.file_block_start") * (1 << 10) + place).alias("line"), value.alias("value"))


def parse_int_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whole numbers of lines that hold one; other lines are dropped."""
    number = F.trim(F.col(value)).try_cast("long")
    return lines.select(number.alias("value")).filter(F.col("value").isNotNull())


def read_int_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_int_lines(spark.read.text(path))


def append_csv(df: DataFrame, folder: str) -> None:
    """Append rows as CSV with a header; map columns become JSON text."""
    cells = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema
    ]
    df.select(*cells).write.mode("append").option("header", True).csv(folder)


def print_rows(df: DataFrame, n: int = 20) -> None:
    """Rows to standard output; a stream prints each micro-batch until it is stopped."""
    if df.isStreaming:
        df.writeStream.format("console").start()
    else:
        df.show(n, truncate=False)


def discard(df: DataFrame) -> None:
    """Run a query for its cost alone."""
    df.write.format("noop").mode("overwrite").save()


def append_lines(spark: SparkSession, lines: Sequence[str], folder: str) -> None:
    """A few driver-side texts as lines of a text file."""
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    rows.coalesce(1).write.mode("append").text(folder)
