"""Topics kept in files: a data source with offsets, consumer groups and a sink that counts a batch once.

A topic is a folder. Messages are Parquet files, one per task and topic partition; what belongs to the
topic is what its batch records name. A record is written once a batch is complete, and gives
the files their offsets, so files of failed tasks or killed runs are never read. A stream's sink looks
for the record of the same batch first: a batch that is run again after a crash changes nothing. One
writer at a time appends to a topic.

Readers take whole offsets ranges. A stream goes on from its own checkpoint. A new one begins at what its
consumer group has committed, else at the earliest offset, or always at the earliest one.

Files are reached by URI through Arrow's file systems, from the driver and the tasks alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

FORMAT = "file_topic"
MESSAGE = "partition int, offset long, key string, value string, timestamp timestamp"
_STORED = pa.schema([("key", pa.string()), ("value", pa.string()), ("timestamp", pa.timestamp("us", tz="UTC"))])

COMMITTED, EARLIEST = "committed", "earliest"
# Messages in a row group: what a reader skips or reads as a whole.
GROUP_ROWS = 1 << 16


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: topic partition, name, messages."""

    files: list[tuple[int, str, int]]


@dataclass
class Span(InputPartition):
    """Messages ``start`` up to ``stop`` of a file whose first has offset ``first``."""

    name: str
    partition: int
    first: int
    start: int
    stop: int

    def __init__(self, name: str, partition: int, first: int, start: int, stop: int) -> None:
        super().__init__(None)
        self.name, self.partition, self.first, self.start, self.stop = name, partition, first, start, stop


class Topic:
    """The files of a topic."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.files, self.root = fs.FileSystem.from_uri(path)

    def write_messages(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file per topic partition; messages keep their order."""
        self.files.create_dir(f"{self.root}/data", recursive=True)
        names: dict[int, str] = {}
        writers: dict[int, pq.ParquetWriter] = {}
        counts: dict[int, int] = {}
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                partitions = table.column("partition").to_pylist()
                for number in dict.fromkeys(partitions):
                    if number not in writers:
                        names[number], counts[number] = f"p{number}-{uuid.uuid4().hex}.parquet", 0
                        writers[number] = pq.ParquetWriter(f"{self.root}/data/{names[number]}", _STORED, filesystem=self.files)
                    own = table.filter(pa.array([p == number for p in partitions]))
                    writers[number].write_table(own.select(_STORED.names).cast(_STORED), row_group_size=GROUP_ROWS)
                    counts[number] += own.num_rows
        finally:
            for writer in writers.values():
                writer.close()
        return Written([(number, names[number], counts[number]) for number in sorted(names)])

    def remove(self, messages: Sequence[Written | None]) -> None:
        """Delete files that no record names."""
        for message in messages:
            for _, name, _ in message.files if message else ():
                self.files.delete_file(f"{self.root}/data/{name}")

    def _names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(info.base_name for info in found if info.is_file and info.base_name.endswith(".json"))

    def _json(self, name: str):
        with self.files.open_input_stream(f"{self.root}/{name}") as file:
            return json.loads(file.read())

    def _put(self, name: str, content) -> None:
        """Written aside and moved, so that a reader sees all of it or nothing."""
        self.files.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0], recursive=True)
        aside = f"{self.root}/{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as file:
            file.write(json.dumps(content).encode())
        self.files.move(aside, f"{self.root}/{name}")

    def record(self, batch: str, messages: Sequence[Written | None]) -> bool:
        """Make the files of a batch part of the topic, in the order of the tasks; not if there is a batch of that name."""
        records = self._names("batches")
        if any(name.split("-", 1)[1] == f"{batch}.json" for name in records):
            self.remove(messages)
            return False
        ends = self.ends()
        files = []
        for message in messages:
            for number, name, n in message.files if message else ():
                first = ends.get(str(number), 0)
                files.append([number, first, n, name])
                ends[str(number)] = first + n
        self._put(f"batches/{len(records):012d}-{batch}.json", {"files": files, "ends": ends})
        return True

    def ends(self) -> dict[str, int]:
        """By partition the offset after the last message."""
        records = self._names("batches")
        return dict(self._json(f"batches/{records[-1]}")["ends"]) if records else {}

    def spans(self, start: dict[str, int], stop: dict[str, int]) -> list[Span]:
        """The parts of files that hold the messages between two offsets."""
        out = []
        for record in self._names("batches"):
            for number, first, n, name in self._json(f"batches/{record}")["files"]:
                low, high = max(first, start.get(str(number), 0)), min(first + n, stop.get(str(number), 0))
                if low < high:
                    out.append(Span(name, number, first, low - first, high - first))
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), *_STORED])
        with self.files.open_input_file(f"{self.root}/data/{span.name}") as source:
            file, at = pq.ParquetFile(source), 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                low, high = max(span.start, at), min(span.stop, at + n)
                if low < high:
                    table = file.read_row_group(group).slice(low - at, high - low)
                    head = [pa.array([span.partition] * (high - low), pa.int32()), pa.array(range(span.first + low, span.first + high), pa.int64())]
                    yield from pa.Table.from_arrays([*head, *table.columns], schema=schema).to_batches()
                at += n

    def committed(self, group: str) -> dict[str, int] | None:
        return self._json(f"groups/{group}.json") if f"{group}.json" in self._names("groups") else None

    def commit(self, group: str, offsets: dict[str, int]) -> None:
        self._replace("groups", group, offsets)

    def planned(self, reader: str) -> dict[str, int] | None:
        return self._json(f"plans/{reader}.json") if f"{reader}.json" in self._names("plans") else None

    def plan(self, reader: str, offsets: dict[str, int]) -> None:
        self._replace("plans", reader, offsets)

    def _replace(self, folder: str, name: str, content) -> None:
        if f"{name}.json" in self._names(folder):
            self.files.delete_file(f"{self.root}/{folder}/{name}.json")
        self._put(f"{folder}/{name}.json", content)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        topic = Topic(self.path)
        return topic.spans({}, topic.ends())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Topic(self.path).read(partition) if isinstance(partition, Span) else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets by partition. Each call for the latest one goes at most ``per_batch`` messages of every partition further.

    Spark asks for the latest offset without saying where the stream is, so the reader writes down how far it
    has planned, under its name. One without a name takes all there is first: it may be going on from a checkpoint.
    """

    def __init__(self, path: str, group: str | None, starting: str, per_batch: int | None, name: str | None) -> None:
        self.path, self.group, self.starting, self.per_batch, self.name = path, group, starting, per_batch, name
        self._at: dict[str, int] | None = None

    def _begin(self, topic: Topic) -> dict[str, int]:
        kept = topic.committed(self.group) if self.group and self.starting == COMMITTED else None
        return kept or {}

    def initialOffset(self) -> dict:
        """Only asked for by a stream without a checkpoint."""
        topic = Topic(self.path)
        begin = self._begin(topic)
        return {partition: begin.get(partition, 0) for partition in topic.ends()} or {"0": 0}

    def latestOffset(self) -> dict:
        topic = Topic(self.path)
        ends = topic.ends()
        if self._at is None:
            self._at = (topic.planned(self.name) or self._begin(topic)) if self.name else ends
        if self.per_batch:
            self._at = {partition: min(end, self._at.get(partition, 0) + self.per_batch) for partition, end in ends.items()}
        else:
            self._at = ends
        if self.name:
            topic.plan(self.name, self._at)
        return self._at or {"0": 0}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return Topic(self.path).spans(start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Topic(self.path).read(partition)

    def commit(self, end: dict) -> None:
        if self.group:
            Topic(self.path).commit(self.group, end)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.batch = path, f"load-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Topic(self.path).write_messages(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        Topic(self.path).record(self.batch, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Topic(self.path).remove(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, producer: str) -> None:
        self.path, self.producer = path, producer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Topic(self.path).write_messages(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        Topic(self.path).record(f"{self.producer}-{batchId}", messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        Topic(self.path).remove(messages)


class FileTopic(DataSource):
    """Options: ``path``; ``group``, ``starting``, ``per_batch`` and ``reader`` of a stream that reads; ``producer`` of one that writes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        limit = self.options.get("per_batch")
        return _StreamReader(self.options["path"], self.options.get("group"), self.options.get("starting", COMMITTED), int(limit) if limit else None, self.options.get("reader"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], self.options.get("producer", "stream"))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FileTopic)
    return spark


def messages(rows: DataFrame, value: Column, timestamp: Column, partition: Column, key: Column | None = None) -> DataFrame:
    """Rows as messages; the topic partition is given."""
    none = F.lit(None).cast("string")
    return rows.select(partition.cast("int").alias("partition"), (none if key is None else key.cast("string")).alias("key"), value.alias("value"), timestamp.cast("timestamp").alias("timestamp"))


def send(rows: DataFrame, path: str) -> None:
    """Append the messages of a finished frame, in the order of its tasks."""
    _registered(rows.sparkSession)
    rows.write.format(FORMAT).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All messages: partition, offset, key, value, timestamp."""
    return _registered(spark).read.format(FORMAT).option("path", path).load()


def stream(spark: SparkSession, path: str, group: str | None = None, starting: str = COMMITTED, per_batch: int | None = None, name: str | None = None) -> DataFrame:
    """The topic as a stream of at most ``per_batch`` messages of each partition a micro-batch.

    With ``starting`` committed a new stream begins where its ``group`` has committed, else at the
    earliest offset; with earliest it always begins there. One with a checkpoint goes on from it. The limit
    needs a ``name``, one for each checkpoint; without it the first micro-batch takes all there is.
    """
    reader = _registered(spark).readStream.format(FORMAT).option("path", path).option("starting", starting)
    for name, option in (("group", group), ("per_batch", per_batch), ("reader", name)):
        reader = reader if option is None else reader.option(name, str(option))
    return reader.load()


def to_topic(rows: DataFrame, path: str, checkpoint: str, producer: str = "stream"):
    """A stream of messages on its way to a topic. A batch that is run again is in the topic once."""
    _registered(rows.sparkSession)
    return rows.writeStream.format(FORMAT).option("path", path).option("producer", producer).option("checkpointLocation", checkpoint)
