"""Benchmark passages in training texts, found with suffix arrays.

Every shard of the training texts (a few megabytes of a partition) becomes a suffix array of
words. Each suffix of a benchmark item is looked up in it by binary search; the interval of
suffixes that begin with the same window gives all places of that window. Neighbouring windows
are joined to the longest verbatim matches, with their places in item and document. Suffixes
that cannot hold a window (one of the next words is in no item) are left out of the array:
they would never be found.

The items are shipped in blocks of bounded size, one pass over the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.rows import id_and_text, slices, text_digest, texts_of

# Words of a window; an item of fewer words is one window.
WINDOW = 10
# Bytes of item text in one block.
BLOCK_BYTES = 16 << 20

# Words are digits, small letters and all characters beyond ASCII; A-Z count as small letters.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_HIGHEST = np.int64(1) << np.int64(31)

MATCHES = "array<struct<item_id: string, item_word: int, doc_word: int, n_words: int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Items:
    """The windows of some items, as numbers of words; 0 is no word of any item."""

    def __init__(self, named: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.window = [], window
        text, item, place, width = [0], [], [], []
        for name, raw in named:
            words = [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words_of(raw)]
            if not words:
                continue
            n, first = min(window, len(words)), len(text)
            text += [*words, 0]
            starts = range(first, first + len(words) - n + 1)
            place += starts
            item += [len(self.names)] * len(starts)
            width += [n] * len(starts)
            self.names.append(name)
        self.item, self.width = np.array(item, dtype=np.int64), np.array(width, dtype=np.int64)
        self.place = np.array(place, dtype=np.int64)
        self.least = int(self.width.min()) if len(place) else 0
        firsts = np.r_[0, np.flatnonzero(np.diff(self.item)) + 1] if len(place) else np.empty(0, dtype=np.int64)
        self.item_first = self.place[firsts]
        padded = np.r_[np.array(text, dtype=np.int64), np.zeros(window, dtype=np.int64)]
        grid = padded[self.place[:, None] + np.arange(window)] if len(place) else np.zeros((0, window), np.int64)
        beyond = np.arange(window) >= self.width[:, None]
        self.low, self.high = _packed(np.where(beyond, 0, grid)), _packed(np.where(beyond, _HIGHEST - 1, grid))


def _packed(grid: np.ndarray) -> list[np.ndarray]:
    """Columns of words, two in one number."""
    if grid.shape[1] % 2:
        grid = np.c_[grid, np.zeros(len(grid), dtype=np.int64)]
    return [grid[:, i] * _HIGHEST + grid[:, i + 1] for i in range(0, grid.shape[1], 2)]


def suffix_array(words: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places whose next ``least`` words are all in items, sorted by their next ``depth`` words; and those words."""
    at = np.arange(len(words))
    run = np.minimum.accumulate(np.where(words == 0, at, len(words))[::-1])[::-1] - at
    places = np.flatnonzero(run >= least)
    padded = np.r_[words, np.zeros(depth, dtype=np.int64)]
    grid = padded[places[:, None] + np.arange(depth)]
    # a word after the end of the run is of no use
    grid[np.arange(depth) >= run[places][:, None]] = 0
    columns = _packed(grid)
    order = np.lexsort(columns[::-1])
    return places[order], [column[order] for column in columns]


def _bound(columns: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of every wanted row: the first place that is not before it, or the first after it."""
    low, high = np.zeros(len(wanted[0]), dtype=np.int64), np.full(len(wanted[0]), len(columns[0]), dtype=np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(columns[0]) - 1)
        less, same = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
        for column, want in zip(columns, wanted):
            here = column[middle]
            less |= same & (here < want)
            same &= here == want
        right = open_ & (less | (same if after else False))
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def matches_in(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches of items in a text: place in the text, item, word of the item, number of words."""
    empty = np.empty(0, dtype=np.int64)
    places, columns = suffix_array(words, items.least, items.window) if len(items.item) else (empty, [])
    if not len(places):
        return empty, empty, empty, empty
    low, high = _bound(columns, items.low, False), _bound(columns, items.high, True)
    found = np.repeat(np.arange(len(low)), high - low)
    within = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    place = places[low[found] + within]
    diagonal = place - items.place[found]
    order = np.lexsort((place, diagonal, items.item[found]))
    place, found, diagonal = place[order], found[order], diagonal[order]
    first = np.ones(len(place), dtype=bool)
    first[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1) | (items.item[found][1:] != items.item[found][:-1])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, len(place)]) + items.width[found[starts]] - 1
    item = items.item[found[starts]]
    return place[starts], item, items.place[found[starts]] - items.item_first[item], lengths


def _search(rows: DataFrame, items: Items) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        for batch in slices(batches, "text"):
            split = [words_of(text) for text in texts_of(batch, "text")]
            counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            known = map(items.vocabulary.get, chain.from_iterable((*words, b"") for words in split), repeat(0))
            numbers = np.fromiter(known, dtype=np.int64, count=int(counts.sum()) + len(split))
            place, item, item_word, lengths = matches_in(numbers, items)
            begins = np.cumsum(counts + 1) - (counts + 1)
            doc = np.searchsorted(begins, place, side="right") - 1
            order = np.lexsort((item, place))
            doc, place, item, item_word, lengths = (x[order] for x in (doc, place, item, item_word, lengths))
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(split)))].astype(np.int32)
            values = pa.StructArray.from_arrays(
                [
                    pa.array([items.names[i] for i in item.tolist()], pa.string()), pa.array(item_word, pa.int32()),
                    pa.array(place - begins[doc], pa.int32()), pa.array(lengths, pa.int32()),
                ],
                names=["item_id", "item_word", "doc_word", "n_words"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "digest", "n_words", "matches"],
            )

    return rows.mapInArrow(run, f"doc_id long, digest long, n_words long, matches {MATCHES}")


def search(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    unnamed: bool = False,
) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``n_words`` and ``matches`` of every document.

    Null texts have no words. Items without a word match nothing, nor does an empty benchmark; those
    without an id match only if ``unnamed``, under the name null. Rows of one item id are matched each and carry the same name. Repeated documents
    stay; other columns are ignored.
    """
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    items = benchmark.select(benchmark[item_column].cast("string").alias("item"), benchmark[item_text_column].alias("text"))
    items = items.filter(F.col("text").isNotNull() & (F.col("item").isNotNull() | F.lit(unnamed)))
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first()["size"] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    passes = []
    for block in range(blocks):
        found = items.filter(part == block).toPandas().sort_values(["item", "text"])
        names = [item if isinstance(item, str) else None for item in found["item"]]
        passes.append(_search(rows, Items(list(zip(names, found["text"])), window)))
    if blocks == 1:
        return passes[0]
    every = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )
    return every.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def hit_words(matches: Column) -> Column:
    """How many words of the document are in any match."""
    spans = F.transform(matches, lambda m: F.sequence(m["doc_word"], m["doc_word"] + m["n_words"] - 1))
    return F.size(F.array_distinct(F.flatten(spans))).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs, be it one without an id."""
    found = search(docs, benchmark, id_column, text_column, **({"unnamed": True} | options)).filter(F.size("matches") > 0)
    affected = found.select(F.col("doc_id").alias("_1"), F.col("digest").alias("_2")).distinct()
    packed = docs.select(F.struct("*").alias("row"), docs[id_column].cast("long").alias("id"), text_digest(docs[text_column]).alias("digest"))
    same = packed["id"].eqNullSafe(affected["_1"]) & (packed["digest"] == affected["_2"])
    return packed.join(affected, same, "left_anti").select("row.*")
