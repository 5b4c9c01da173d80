"""Throughput samples of ragged length, without following the messages one by one.

A sample ends with the first message at least ``width`` after the one it began with, which begins the
next. Where a sample begins thus hangs on all samples before. Time is cut into chunks of a few widths.
Within a chunk every message at which a sample may begin first is followed to the end of the chunk. That
gives jumps from chunk to chunk, of which only few messages of a chunk are the start. Jumps are doubled
(two steps, four, eight, ...) and taken from the first message, until no jump is left: after so many
rounds as the number of chunks has bits, all places where samples begin in a chunk first are known, and
each chunk tells its own. A task holds the distinct times of one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.intervals import micros
from gavelspark.operators.scan import present, running_before
from gavelspark.session import shared_folder

# A chunk is so many widths long.
CHUNK_WIDTHS = 16
# Chunks of chunks, for what is carried over all of them.
_WIDE = 1 << 10


def _kept(table: DataFrame, path: str) -> DataFrame:
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _ends(at: np.ndarray, width: int) -> np.ndarray:
    """For each time the last sample start of the chunk, if a sample begins there."""
    following = np.searchsorted(at, at + width)
    jump = np.where(following < len(at), following, np.arange(len(at)))
    while (further := jump[jump] != jump).any():
        jump = np.where(further, jump[jump], jump)
    return at[jump]


def _sorted(table: pa.Table, name: str) -> np.ndarray:
    return np.sort(table.column(name).to_numpy())


def _first(table: pa.Table, *names: str):
    return [table.column(name)[0].as_py() for name in names]


def _entries(ticks: DataFrame, width: int) -> DataFrame:
    """Times at which a sample may be the first to begin in its chunk, and from when on the next chunks' first one may."""

    def run(table: pa.Table) -> pa.Table:
        key, chunk = _first(table, "key", "chunk")
        at = _sorted(table, "at")
        # the message before it still belongs to a sample that began before the chunk
        may = np.r_[True, at[:-1] < chunk + width]
        due = _ends(at, width)[may] + width
        n = int(may.sum())
        return pa.table({"key": [key] * n, "chunk": pa.array([chunk] * n, pa.int64()), "entry": at[may], "due": due})

    return ticks.groupBy("key", "chunk").applyInArrow(run, "key string, chunk long, entry long, due long")


def _jumps(entries: DataFrame, length: int) -> DataFrame:
    """``key``, ``a``, ``b``: a sample that is the first of its chunk, and the first one of a later chunk."""
    chunks = entries.groupBy("key", "chunk").agg(F.min("entry").alias("first")).withColumn("back", -F.col("chunk"))
    after = running_before(chunks, ["key"], [("back", length * _WIDE)], {"following": ("min", "first")}).select("key", "chunk", "following")
    known = entries.join(after.select(F.col("key").alias("key"), F.col("chunk").alias("chunk"), F.col("following").alias("following")), ["key", "chunk"])
    target = F.col("due") - F.pmod(F.col("due"), F.lit(length))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        due, starts = left.column("due").to_numpy(), left.column("entry").to_numpy()
        if right.num_rows:
            entry = _sorted(right, "entry")
            place = np.searchsorted(entry, due)
            beyond = _first(right, "following")[0]
            found = [int(entry[p]) if p < len(entry) else beyond for p in place.tolist()]
        else:
            found = left.column("following").to_pylist()
        keys = left.column("key") if left.num_rows else pa.array([], pa.string())
        return pa.table({"key": keys, "a": pa.array(starts, pa.int64()), "b": pa.array(found, pa.int64())})

    left = known.select("key", target.alias("chunk"), "entry", "due", "following").groupBy("key", "chunk")
    # names of their own: both sides come from one table
    right = known.select(*[F.col(name).alias(name) for name in ("key", "chunk", "entry", "following")]).groupBy("key", "chunk")
    return left.cogroup(right).applyInArrow(run, "key string, a long, b long").filter("b is not null")


def _reached(starts: DataFrame, jumps: DataFrame, folder: str) -> DataFrame:
    """All times that jumps lead to from ``starts`` (``key``, ``at``), these included; steps are doubled each round."""
    reached, step = _kept(starts, f"{folder}/reached0"), _kept(jumps, f"{folder}/jumps0")
    number = 0
    while not step.isEmpty():
        number += 1
        ahead = reached.join(step.select(F.col("key").alias("key"), F.col("a").alias("at"), F.col("b").alias("b")), ["key", "at"]).select("key", F.col("b").alias("at"))
        reached = _kept(reached.unionByName(ahead), f"{folder}/reached{number}")
        twice = step.join(step.select(F.col("key").alias("key"), F.col("a").alias("b"), F.col("b").alias("c")), ["key", "b"]).select("key", "a", F.col("c").alias("b"))
        step = _kept(twice, f"{folder}/jumps{number}")
    return reached


def _told(ticks: DataFrame, reached: DataFrame, width: int) -> DataFrame:
    """Per chunk the samples that begin in it, with their messages there, and (``began`` null) the messages before the first of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, chunk = _first(left, "key", "chunk")
        order = np.argsort(left.column("at").to_numpy())
        at, n = left.column("at").to_numpy()[order], left.column("n").to_numpy()[order]
        begins = []
        if right.num_rows:
            place = int(np.searchsorted(at, _first(right, "at")[0]))
            while place < len(at):
                begins.append(place)
                place = int(np.searchsorted(at, at[place] + width))
        cuts = [0, *begins, len(at)]
        counts = [int(n[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
        times = at[begins].tolist()
        began, ended = [None, *times], [*times, None]
        rows = len(began)
        return pa.table({
            "key": [key] * rows, "chunk": pa.array([chunk] * rows, pa.int64()), "began": pa.array(began, pa.int64()),
            "ended": pa.array(ended, pa.int64()), "messages": pa.array(counts, pa.int64()),
        })

    return ticks.groupBy("key", "chunk").cogroup(reached.groupBy("key", "chunk")).applyInArrow(run, "key string, chunk long, began long, ended long, messages long")


def ragged_samples(messages: DataFrame, width: str = "2 seconds", ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Messages and messages per second from one sample's first message to the next one's, for samples that have ended.

    The first message (of a key) begins the first sample. Rows without a time or key count for nothing;
    messages of one time belong together.
    """
    spark, width_us = messages.sparkSession, micros(width)
    length = CHUNK_WIDTHS * width_us
    folder = shared_folder(spark, "samples")
    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    chunk = F.col("at") - F.pmod(F.col("at"), F.lit(length))
    counted = present(messages, ts, *keys).select(key.alias("key"), at.alias("at")).groupBy("key", "at").agg(F.count("*").alias("n"))
    ticks = _kept(counted.withColumn("chunk", chunk), f"{folder}/ticks")

    jumps = _jumps(_kept(_entries(ticks, width_us), f"{folder}/entries"), length)
    begin = ticks.groupBy("key").agg(F.min("at").alias("at"))
    reached = _reached(begin, jumps, folder).withColumn("chunk", chunk)

    told = _kept(_told(ticks, reached, width_us), f"{folder}/told")
    last = told.groupBy("key", "chunk").agg(F.max("began").alias("last"))
    open_ = running_before(last, ["key"], [("chunk", length * _WIDE)], {"open": ("max", "last")}).select("key", "chunk", "open")
    # what a chunk has before its first sample belongs to the last one of the chunks before
    before = told.filter("began is null").join(open_, ["key", "chunk"]).select("key", F.col("open").alias("began"), "ended", "messages")
    parts = told.filter("began is not null").select("key", "began", "ended", "messages").unionByName(before.filter("began is not null"))
    whole = parts.groupBy("key", "began").agg(F.max("ended").alias("ended"), F.sum("messages").alias("messages")).filter("ended is not null")

    kind = messages.schema[ts].dataType.simpleString()
    time = lambda name: F.timestamp_micros(name).cast(kind).alias(name)
    named = []
    if keys:
        parsed = F.from_json("key", messages.select(*keys).schema)
        named = [parsed[name].alias(name) for name in keys]
    rate = F.col("messages") * 1_000_000.0 / (F.col("ended") - F.col("began"))
    return whole.select(*named, time("began"), time("ended"), "messages", rate.alias("per_second"))
