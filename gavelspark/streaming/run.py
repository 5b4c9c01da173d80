"""Starting streams and getting their results and measurements."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from gavelspark.operators import telemetry
from gavelspark.session import shared_folder
from gavelspark.sources.files import append_lines


def to_files(stream: DataFrame, folder: str, output: str = "out", checkpoint: str = "state") -> DataStreamWriter:
    """Append results to files, exactly once: a restart goes on from the checkpoint next to them."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/{output}").option("checkpointLocation", f"{folder}/{checkpoint}")
    )


def run_available(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds now; its results as a batch frame."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, label)
    query = to_files(stream, folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_live(stream: DataFrame, label: str, folder: str | None = None, output: str = "out") -> tuple[DataFrame, DataFrame]:
    """Run a stream micro-batch by micro-batch until its sources have no more; its results and its progress reports.

    Each micro-batch takes what the sources hand out at a time, and a last one without rows closes what the
    watermark has passed. Reports are kept by a listener, all of them, and come as parsed rows. Not for
    streams with timers or state that go by the clock: those never run out of micro-batches.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, label)
    log = ProgressLog(spark, f"{folder}/progress")
    spark.streams.addListener(log)
    try:
        query = to_files(stream, folder, output).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        log.wait_for(str(query.runId))
    finally:
        spark.streams.removeListener(log)
    reports = telemetry.parse_progress(spark.read.text(f"{folder}/progress")).filter(F.col("runId") == str(query.runId))
    return spark.read.schema(stream.schema).parquet(f"{folder}/{output}"), reports


def run_through(writer: DataStreamWriter) -> None:
    """Run a stream into its sink until its sources have no more."""
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def kept_state(spark: SparkSession, folder: str, operator: int, variable: str) -> DataFrame:
    """What a variable of a stopped stream's operator holds: the key's and the value's fields, one row per key."""
    read = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    return read.load(f"{folder}/state").select("key.*", "value.*")


def each_kept(state: DataFrame) -> DataFrame:
    """A row for each entry of kept tables, whose columns are arrays."""
    columns = [name for name, kind in state.dtypes if kind.startswith("array")]
    return state.select(F.explode(F.arrays_zip(*columns)).alias("_each")).select("_each.*")


def zone_free(df: DataFrame) -> DataFrame:
    """Times as the tables have them, without a zone."""
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name, kind in df.dtypes if kind == "timestamp"})


Partial = Callable[[DataFrame], DataFrame]


def run_partials(
    stream: DataFrame, partials: dict[str, Partial], label: str, folder: str | None = None
) -> dict[str, DataFrame]:
    """Aggregate each micro-batch on its own; by name the partial results of all batches.

    A batch that is run again overwrites its own parts. Whoever reads the parts merges them,
    which is all that sums, counts, minima and maxima need, and does not depend on what came in
    which batch.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, label)
    nothing = spark.createDataFrame([], stream.schema)
    schemas = {name: partial(nothing).schema for name, partial in partials.items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, partial in partials.items():
            partial(batch).write.mode("overwrite").parquet(f"{folder}/{name}/{batch_id}")

    _run_batches(stream, write, folder)
    return {name: _parts(spark, schema, f"{folder}/{name}") for name, schema in schemas.items()}


# New rows and what was carried from earlier batches give the results and what is carried on.
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_carried(
    stream: DataFrame, step: Step, carried: T.StructType | str, label: str, folder: str | None = None, order: str = "seq"
) -> DataFrame:
    """Run a batch operator on each micro-batch, together with a table that it carries on.

    The table holds what later rows may still meet, say the last row of each key. It is
    written next to the results, batch by batch, so that a batch that is run again begins
    with the same table and overwrites its own results. No key is gathered in one task.

    Later micro-batches have to be later in ``order``: the largest value so far is carried along,
    and the run fails at a micro-batch that holds a smaller one, before it writes results.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, label)
    before = spark.createDataFrame([], carried)
    schema = step(spark.createDataFrame([], stream.schema), before)[0].schema
    reached = T.StructType([T.StructField("reached", stream.schema[order].dataType)])

    def write(batch: DataFrame, batch_id: int) -> None:
        read = batch.sparkSession.read
        held = read.schema(before.schema).parquet(f"{folder}/carried/{batch_id - 1}") if batch_id else before
        low, high = batch.agg(F.min(order), F.max(order)).first()
        last = read.schema(reached).parquet(f"{folder}/reached/{batch_id - 1}").first()["reached"] if batch_id else None
        if low is not None and last is not None and low < last:
            raise ValueError(f"{label}: micro-batch {batch_id} has {order} {low}, an earlier one had {last}: files have to come in the order of {order}")
        last = max((x for x in (last, high) if x is not None), default=None)
        batch.sparkSession.createDataFrame([(last,)], reached).write.mode("overwrite").parquet(f"{folder}/reached/{batch_id}")
        results, left = step(batch, held)
        results.write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")
        left.write.mode("overwrite").parquet(f"{folder}/carried/{batch_id}")

    _run_batches(stream, write, folder)
    return _parts(spark, schema, f"{folder}/out")


# Two frames give their join.
Join = Callable[[DataFrame, DataFrame], DataFrame]


def run_joined(left: DataFrame, right: DataFrame, join: Join, label: str, folder: str | None = None) -> DataFrame:
    """Inner join of two streams whose histories have to stay: new rows of either side meet all rows of the other so far.

    The histories are files, a part for each micro-batch, written once. A store of keyed state would write every row
    to several tables and look it up by itself. A batch that is run again overwrites its own parts.
    """
    spark = left.sparkSession
    folder = folder or shared_folder(spark, label)
    sides = {"left": left, "right": right}
    none = {name: F.lit(None).cast(T.StructType(side.schema.fields)).alias(name) for name, side in sides.items()}
    row = {name: F.struct(*side.columns).alias(name) for name, side in sides.items()}
    both = left.select(row["left"], none["right"]).unionByName(right.select(none["left"], row["right"]))
    schema = join(*[spark.createDataFrame([], side.schema) for side in sides.values()]).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        read = batch.sparkSession.read
        new, old = {}, {}
        for name, side in sides.items():
            parts = [f"{folder}/{name}/{i}" for i in range(batch_id + 1)]
            batch.filter(F.col(name).isNotNull()).select(f"{name}.*").write.mode("overwrite").parquet(parts[-1])
            new[name] = read.schema(side.schema).parquet(parts[-1])
            old[name] = read.schema(side.schema).parquet(*parts[:-1]) if batch_id else None
        results = join(new["left"], new["right"])
        if batch_id:
            results = results.unionByName(join(new["left"], old["right"])).unionByName(join(old["left"], new["right"]))
        results.write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

    _run_batches(both, write, folder)
    return _parts(spark, schema, f"{folder}/out")


def _run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> None:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


def _parts(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    """All parts in a folder; there may be none."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/none")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """Results as the temporary view ``name``. They end up on the driver: for small checks only."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode)


def checkpointed(writer: DataStreamWriter, folder: str, interval: str = "10 seconds") -> DataStreamWriter:
    """A running stream that commits its progress and state every ``interval``."""
    return writer.option("checkpointLocation", folder).trigger(processingTime=interval)


LATENCY_METRICS = "latency"


def latency_sink(stream: DataFrame, ts: str = "ts", metrics: str = LATENCY_METRICS) -> DataStreamWriter:
    """Drop all rows, but report count, mean and largest delay of each micro-batch in the progress."""
    return observed_delay(stream, ts, metrics).writeStream.format("noop")


def observed_delay(stream: DataFrame, ts: str = "ts", metrics: str = LATENCY_METRICS) -> DataFrame:
    """The stream, whose progress tells the number of rows of each micro-batch and how old they are."""
    delay = F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(ts).cast("timestamp"))
    return stream.observe(
        metrics, F.count("*").alias("rows"), F.avg(delay).alias("mean_ms"), F.max(delay).alias("max_ms")
    )


def progress_lines(query: StreamingQuery) -> list[str]:
    """The recent progress reports as JSON. Spark keeps a bounded number of them."""
    return [progress.json for progress in query.recentProgress]


def save_progress(spark: SparkSession, lines: Sequence[str], folder: str) -> None:
    append_lines(spark, lines, folder)


class ProgressLog(StreamingQueryListener):
    """Keeps progress reports of all streams and writes them out in files of ``per_file`` reports."""

    def __init__(self, spark: SparkSession, folder: str, per_file: int = 100) -> None:
        self._spark, self._folder, self._per_file = spark, folder, per_file
        self._lines: list[str] = []
        self._ended: set[str] = set()
        self._change = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._lines.append(event.progress.json)
        if len(self._lines) >= self._per_file:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60) -> None:
        """Until the listener, which runs on its own, has seen the end of a run."""
        with self._change:
            if not self._change.wait_for(lambda: run_id in self._ended, seconds):
                raise TimeoutError(f"no end of run {run_id} was reported")

    def flush(self) -> None:
        lines, self._lines = self._lines, []
        if lines:
            save_progress(self._spark, lines, self._folder)
