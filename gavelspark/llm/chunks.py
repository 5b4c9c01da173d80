"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: h becomes 2 h + g(byte), so that it depends on the
last 32 bytes only. A chunk ends where the hash is the smallest within ``reach`` bytes on either
side. What was inserted before a passage therefore moves its chunk borders with it, and equal
passages have equal chunks but at their ends. Chunks are deduplicated by digest: the first one
(smallest id, then place) stays. A document loses a run of consecutive later chunks if the
run is long enough; single short ones repeat by chance.

Digests are counted with partial sums, so a chunk of very many documents is one row a task;
only chunks whose digest occurs twice are compared further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.rows import id_and_text, slices, text_digest
from gavelspark.session import shared_folder

# A chunk ends at the smallest hash within so many bytes; it has that many at least, but at the end.
REACH = 20
# Longer stretches without an end, such as one word again and again, are cut.
LONGEST = 512
# Bytes of a run of later chunks that is removed.
LEAST_RUN = 96

_GEAR_BITS = 32
# the gear of a byte: 32 scrambled bits
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ** np.uint64(3) >> np.uint64(32)).astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, over the last 32 of them, by doubling the window."""
    out, width = _GEAR[raw], 1
    while width < _GEAR_BITS:
        out[width:] += out[:-width] << np.uint32(width)
        width *= 2
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` values that end at each place."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[step:] = np.minimum(out[step:], out[:-step])
        done += step
    return out


def borders(raws: list[bytes], reach: int = REACH, longest: int = LONGEST) -> list[list[int]]:
    """For each text the ends of its chunks."""
    gap = _GEAR_BITS + reach
    joined = np.frombuffer(b"".join(bytes(gap) + raw for raw in raws) + bytes(gap), dtype=np.uint8)
    hashes = gear_hash(joined)
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    begins = np.cumsum(sizes + gap) - sizes
    inside = np.zeros(len(joined) + 1, dtype=np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + sizes, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    # no chunk ends within a character
    inside[:-1] &= (joined[1:] & 0xC0) != 0x80
    hashes = np.where(inside, hashes, _NONE)
    before, after = _smallest(hashes, reach), _smallest(hashes[::-1], reach)[::-1]
    end = np.zeros(len(joined), dtype=bool)
    end[1:-1] = (hashes[1:-1] < before[:-2]) & (hashes[1:-1] <= after[2:])
    ends = np.flatnonzero(end) + 1
    cuts = np.searchsorted(ends, np.c_[begins, begins + sizes])
    out = []
    for raw, begin, (a, b) in zip(raws, begins.tolist(), cuts.tolist()):
        found = (ends[a:b] - begin).tolist()
        if raw and (not found or found[-1] != len(raw)):
            found.append(len(raw))
        whole, last = [], 0
        for stop in found:
            while stop - last > longest:
                last += longest
                while raw[last] & 0xC0 == 0x80:
                    last -= 1
                whole.append(last)
            whole.append(stop)
            last = stop
        out.append(whole)
    return out


def chunks(rows: DataFrame, reach: int, longest: int) -> DataFrame:
    """Every chunk: its document (``doc_id``, ``digest``), number, place and size in bytes, and its own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raws = [(text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            ends = borders(raws, reach, longest)
            counts = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends))
            digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for raw, stops in zip(raws, ends) for a, b in zip([0, *stops], stops)])
            both = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            starts = np.fromiter((a for stops in ends for a in [0, *stops][:-1]), dtype=np.int32, count=len(both))
            stops = np.fromiter((b for stops in ends for b in stops), dtype=np.int32, count=len(both))
            owner = np.repeat(np.arange(len(raws)), counts)
            number = np.arange(len(both)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)), batch.column("digest").take(pa.array(owner)), pa.array(number.astype(np.int32)),
                    pa.array(starts), pa.array(stops - starts), pa.array(both[:, 0]), pa.array(both[:, 1]),
                ],
                names=["doc_id", "digest", "number", "start", "size", "h1", "h2"],
            )

    return rows.mapInArrow(run, "doc_id long, digest long, number int, start int, size int, h1 long, h2 long")


def later_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """The chunks whose digest occurred before: in a row of smaller id (null ids first), or earlier in the same text.

    Repeated rows (same id, same text) are one document.
    """
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    found = chunks(rows, reach, longest)
    often = found.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1")
    path = shared_folder(docs.sparkSession, "chunks")
    found.join(often, "h1", "left_semi").write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    place = F.struct("doc_id", "digest", "start")
    first = kept.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    return kept.join(first.drop("last"), ["h1", "h2"]).filter(place > F.col("first")).drop("first", "h1", "h2")


def _runs(numbers: list[tuple[int, int, int]], least_run: int) -> list[tuple[int, int]]:
    """Spans (start, end) of consecutive chunks, given as (number, start, size), that are long enough."""
    spans: list[tuple[int, int]] = []
    last = None
    for number, start, size in sorted(set(numbers)):
        if last is not None and number == last + 1:
            spans[-1] = (spans[-1][0], start + size)
        else:
            spans.append((start, start + size))
        last = number
    return [(a, b) for a, b in spans if b - a >= least_run]


def dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH, longest: int = LONGEST, least_run: int = LEAST_RUN,
) -> DataFrame:
    """``doc_id``, ``text`` without its repeated passages, and ``removed``: their spans in bytes of the old text.

    Every row of ``docs`` is returned. Null and empty texts stay as they are; so does the first
    of several equal texts. Other columns are ignored.
    """
    later = later_chunks(docs, id_column, text_column, reach, longest)
    held = later.groupBy(F.col("doc_id").alias("_1"), F.col("digest").alias("_2")).agg(F.collect_list(F.struct("number", "start", "size")).alias("later"))
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    joined = rows.join(held, rows["doc_id"].eqNullSafe(held["_1"]) & (rows["digest"] == held["_2"]), "left").select("doc_id", "text", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, spans = [], []
            for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
                runs = _runs([(x["number"], x["start"], x["size"]) for x in later or ()], least_run)
                if runs:
                    raw = text.encode("utf-8", "surrogatepass")
                    stays = zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(raw)])
                    text = b"".join(raw[a:b] for a, b in stays).decode("utf-8", "surrogatepass")
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], names=["doc_id", "text", "removed"])

    return joined.mapInArrow(run, "doc_id long, text string, removed array<struct<start: int, end: int>>")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def removed_bytes(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
