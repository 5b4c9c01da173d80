"""Helpers that several operators share: texts out of Arrow batches, row identities, bounded samples."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a task works on at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of about ``limit`` bytes in ``column``; one row may be longer."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def slices_of_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, regrouped into batches of ``rows`` rows and a smaller last one."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null is the empty text."""
    return [text or "" for text in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Two columns of known names, whatever else the table has."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))


def text_digest(text: Column) -> Column:
    """64 bits of a text; null and the empty text differ."""
    return F.xxhash64(text.isNull(), text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def about(rows: DataFrame, total: int, wanted: int, *by: str) -> DataFrame:
    """About ``wanted`` of ``total`` rows, always the same ones, chosen by a hash of columns ``by``."""
    if total <= wanted:
        return rows
    scale = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(scale)) < int(scale * wanted / total))


# A table of few numbers and of so many rows at most is broadcast (some tens of megabytes).
BROADCAST_ROWS = 500_000


def small_or_not(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small: joined without a shuffle of the other side."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed: Spark does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Generations:
    """A bounded cache: two dicts, of which the older is forgotten when the newer is full."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """The keys to compute; the others are in ``new`` from now on."""
        if len(self.new) + len(keys) > self.limit:
            self.new, self.old = {}, self.new
        wanted = keys - self.new.keys()
        known = wanted & self.old.keys()
        self.new.update((key, self.old[key]) for key in known)
        return list(wanted - known) if known else list(wanted)


_BUILT: dict = {}


def built_once(kind: type, source: bytes, *args):
    """``kind(source, *args)``, built once per Python worker."""
    key = (kind, hashlib.md5(source).digest(), args)
    if key not in _BUILT:
        _BUILT[key] = kind(source, *args)
    return _BUILT[key]
