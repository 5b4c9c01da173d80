"""Token ids in files compressed by grammar.

Documents are dealt into shards by ranges of their id. A shard is a row of blocks, each with
the ids of consecutive documents. Within a block frequent pairs of neighbouring symbols are
replaced by new symbols again and again (Re-Pair): every round counts all pairs, takes the
most frequent ones and replaces those that do not overlap a more frequent one, until no pair
occurs often enough. A block keeps
its rules, how many ids each new symbol stands for, and the remaining sequence; any stretch of
ids is decoded without the rest of the block.

The files are Parquet with one row per block, so they lie wherever Spark can write, and a
task that is run again replaces its own rows only.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm.rows import Generations, built_once, id_and_text, slices, text_digest, texts_of
from gavelspark.operators.scan import running_before

# Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
# A round replaces at most so many pairs; rounds end when no pair occurs so often any more.
ROUND_PAIRS, LEAST_COUNT = 2048, 32
CACHED_WORDS = 600_000
# New words that the library gets in one text.
_WORDS_AT_ONCE = 4096
_SLOT_BITS = 18
_MAGIC = b"GRM2"
_HEAD = struct.Struct("<4sIIIBB")


class WordTokenizer:
    """A tokenizer of the tokenizers library that drops white space, word by word with a cache."""

    def __init__(self, source: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source.decode())
        described = json.loads(source)
        suffix = described["model"].get("end_of_word_suffix")
        # the same model for words of small Latin letters, at which its rules of normalisation and splitting change nothing
        bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(described | {"normalizer": None, "pre_tokenizer": bare, "post_processor": None, "added_tokens": []}))
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.cache = Generations(CACHED_WORDS)
        # what is taken for granted below: words stand alone, capitals and marks at the end may be split off
        probe = ["a", "don't", "wORds9", "<|x|>", "é,", "", "b", "Word.", "WORD", "word", "x!!", "it's,", "Ünd###", "é", "9.", "ÉÇÑß", "Ÿș", "œuvreŉ", "abc"]
        alone = [np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes() for word in probe]
        if self._by_offset(probe) != alone or self.encode(probe) != alone:
            raise ValueError("the tokenizer does not take words one by one")

    def _by_offset(self, words: list[str]) -> list[bytes]:
        """The ids of words, which the library gets in one text; its offsets tell whose each id is."""
        out: list[bytes] = []
        for part in _parts(words):
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((start for start, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            out += _cut(np.array(found.ids, dtype="<u4"), np.searchsorted(starts, ends))
        return out

    def _by_end(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, each of which has one id that ends a word: its last."""
        out: list[bytes] = []
        for part in _parts(words):
            joined = " ".join(part)
            library = self.bare if joined.islower() and not _BEYOND_LATIN.search(joined) else self.library
            ids = np.array(library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            out += _cut(ids, stops) if len(stops) == len(part) and stops[-1] == len(ids) else self._by_offset(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        small = [text.lower() if text.isascii() and "<|" not in text else text for text in texts]
        split = [text.replace("\n", " ").split(" ") for text in small]
        new = self.cache.missing(set().union(*split))
        if new:
            self._learn(new)
        ids_of = self.cache.new.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Spellings that the tokenizer takes alike are given to the library once:
        capital Latin letters, and marks at the end, which are a token run of their own after a letter."""
        known = self.cache.new
        small = [word for word in words if word.islower() and word.isalpha()]
        known.update(zip(small, self._by_end(small)))
        spelt = {word: _plain(word) for word in set(words).difference(small)}
        asked = {part for parts in spelt.values() for part in parts} - known.keys()
        letters = [word for word in asked if word.isalpha()]
        others = list(asked.difference(letters))
        found = dict(zip(letters, self._by_end(letters)))
        found.update(zip(others, self._by_offset(others)))
        for word, (base, marks) in spelt.items():
            ids = found[base] if base in found else known[base]
            known[word] = ids + (found[marks] if marks in found else known[marks]) if marks else ids


# Below it, small letters are the same in every normal form that composes, and in small letters.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
# Marks of ASCII; the apostrophe may begin a token with the letters after it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(word: str) -> tuple[str, str]:
    """A word, in small letters if it is Latin, and the marks at its end if they follow a Latin letter."""
    if "<|" in word:
        return word, ""
    # the dotted capital I turns into two characters
    if word.isascii() or not _BEYOND_LATIN.search(word) and "\u0130" not in word:
        word = word.lower()
    base = word.rstrip(_MARKS)
    if len(base) == len(word) or not (base[-1:].lower().isalpha() and base[-1] < "\u0250"):
        return word, ""
    return base, word[len(base) :]


def _parts(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of which each is one text for the library."""
    for at in range(0, len(words), _WORDS_AT_ONCE):
        yield words[at : at + _WORDS_AT_ONCE]


def _cut(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The bytes of ids up to each stop."""
    raw, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def compress(ids: np.ndarray, round_pairs: int = ROUND_PAIRS, least_count: int = LEAST_COUNT) -> bytes:
    """Ids as a block: header, rules, expansion lengths, sequence; symbols take as many bits as the largest needs."""
    base = int(ids.max()) + 1 if len(ids) else 0
    sequence = ids.astype(np.uint32)
    rules, lengths = np.empty((0, 2), dtype=np.uint32), np.empty(0, dtype=np.uint32)
    while len(sequence) > 1:
        # both symbols of a pair in one number: of 32 bits as long as symbols have 16
        kind, shift = (np.uint32, 16) if base + len(rules) <= 1 << 16 else (np.uint64, 32)
        pairs = sequence.astype(kind)
        pairs = (pairs[:-1] << kind(shift)) | pairs[1:]
        wanted = _frequent(pairs, least_count, round_pairs)
        if not len(wanted):
            break
        place, rank = _taken(pairs, wanted)
        used = np.flatnonzero(np.bincount(rank, minlength=len(wanted)))
        number = np.zeros(len(wanted), dtype=np.uint32)
        number[used] = np.arange(base + len(rules), base + len(rules) + len(used), dtype=np.uint32)
        found = wanted[used]
        added = np.stack([found >> kind(shift), found & kind((1 << shift) - 1)], axis=1).astype(np.uint32)
        rules = np.concatenate([rules, added])
        lengths = np.concatenate([lengths, _spans(added, base, lengths).sum(axis=1).astype(np.uint32)])
        sequence[place] = number[rank]
        keep = np.ones(len(sequence), dtype=bool)
        keep[place + 1] = False
        sequence = sequence[keep]
    bits, span_bits = (max(1, int(x).bit_length()) for x in (base + len(rules) - 1 if len(ids) else 0, lengths.max(initial=0)))
    head = _HEAD.pack(_MAGIC, base, len(rules), len(sequence), bits, span_bits)
    return head + pack(rules.ravel(), bits) + pack(lengths, span_bits) + pack(sequence, bits)


def _frequent(pairs: np.ndarray, least_count: int, most: int) -> np.ndarray:
    """The pairs that occur often enough, at most ``most``: the most frequent first, smaller ones first among equals."""
    ordered = np.sort(pairs)
    # a pair that occurs often enough is found again so many places on
    again = ordered[least_count - 1 :]
    again = again[again == ordered[: len(again)]]
    found = again[np.r_[True, again[1:] != again[:-1]]] if len(again) else again
    counts = np.searchsorted(ordered, found, side="right") - np.searchsorted(ordered, found)
    return found[np.lexsort((found, -counts))[:most]]


def _taken(pairs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at which a wanted pair is replaced, and the ranks of these pairs.

    A pair is replaced where neither neighbour is a better one; in a run of one pair every other one.
    """
    marked = np.zeros(1 << _SLOT_BITS, dtype=bool)
    marked[_slots(wanted)] = True
    place = np.flatnonzero(marked[_slots(pairs)])
    order = np.argsort(wanted)
    ordered, held = wanted[order], pairs[place]
    spot = np.minimum(np.searchsorted(ordered, held), len(wanted) - 1)
    hit = ordered[spot] == held
    place, rank = place[hit], order[spot[hit]]
    # of two places in a row the one of the worse rank goes
    close = place[1:] == place[:-1] + 1
    best = np.ones(len(place), dtype=bool)
    best[1:] &= ~(close & (rank[:-1] < rank[1:]))
    best[:-1] &= ~(close & (rank[1:] < rank[:-1]))
    place, rank = place[best], rank[best]
    first = np.r_[True, (place[1:] != place[:-1] + 1) | (rank[1:] != rank[:-1])]
    at = np.arange(len(place))
    fine = (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
    return place[fine], rank[fine]


def _slots(pairs: np.ndarray) -> np.ndarray:
    """A slot for every pair."""
    if pairs.dtype == np.uint32:
        return pairs * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS)
    return pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)


def pack(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, in a row, the highest bit first."""
    wide = np.unpackbits(numbers.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(raw: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    """``count`` packed numbers from byte ``at`` on, and where they end."""
    stop = at + (count * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(raw, np.uint8, stop - at, at), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.int64), stop


def _spans(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    made = symbols >= base
    out = np.ones(symbols.shape, dtype=np.int64)
    out[made] = lengths[symbols[made].astype(np.int64) - base]
    return out


class Block:
    """A compressed block, opened for reading."""

    def __init__(self, raw: bytes) -> None:
        magic, self.base, rules, symbols, bits, span_bits = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a block of ids")
        pairs, at = unpack(raw, _HEAD.size, 2 * rules, bits)
        self.rules = pairs.reshape(-1, 2)
        self.lengths, at = unpack(raw, at, rules, span_bits)
        self.sequence, _ = unpack(raw, at, symbols, bits)
        self.ends = np.cumsum(_spans(self.sequence, self.base, self.lengths))
        self._expanded: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols in a row, and where each symbol's begin; symbols below ``base`` are themselves."""
        if self._expanded is None:
            symbols = np.arange(self.base + len(self.rules))
            while (made := symbols >= self.base).any():
                wide = np.repeat(symbols, 1 + made)
                place = np.cumsum(1 + made) - 1
                pair = self.rules[symbols[made] - self.base]
                wide[place[made] - 1], wide[place[made]] = pair[:, 0], pair[:, 1]
                symbols = wide
            spans = np.r_[np.ones(self.base, dtype=np.int64), self.lengths]
            self._expanded = symbols.astype("<u4"), np.cumsum(spans) - spans
        return self._expanded

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; only the symbols that hold them are expanded."""
        stop = len(self) if stop is None else min(stop, len(self))
        if stop <= start:
            return np.empty(0, dtype="<u4")
        first, last = np.searchsorted(self.ends, [start, stop - 1], side="right")
        symbols = self.sequence[first : last + 1]
        begun = int(self.ends[first - 1]) if first else 0
        ids, begins = self._expansions()
        spans = np.diff(np.r_[begun, self.ends[first : last + 1]])
        places = np.repeat(begins[symbols] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        return ids[places[start - begun : stop - begun]]


def write(docs: DataFrame, tokenizer: bytes, end_id: int, path: str, id_column: str = "doc_id", text_column: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending order of the id.

    Null texts are empty. Null ids come first; rows of one id come in the order of a hash of
    their texts. Other columns are ignored. An empty table writes no block.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    dealt = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = built_once(WordTokenizer, shipped.value)
        shard, number = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        names, parts, held = [], [], 0

        def block() -> pa.RecordBatch:
            joined = np.frombuffer(b"".join(parts), dtype="<u4")
            row = {"shard": shard, "number": number, "n_ids": len(joined), "doc_ids": names, "counts": [len(x) // 4 for x in parts], "block": compress(joined)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in slices(batches, "text"):
            for name, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts_of(batch, "text"))):
                names.append(name)
                parts.append(ids + end)
                held += len(parts[-1]) // 4
                if held >= block_ids:
                    yield block()
                    names, parts, held, number = [], [], 0, number + 1
        if names:
            yield block()

    dealt.mapInArrow(run, _SCHEMA).write.parquet(path)


_SCHEMA = "shard int, number int, n_ids long, doc_ids array<long>, counts array<long>, block binary"
_ARROW = pa.schema([
    ("shard", pa.int32()), ("number", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("block", pa.binary()),
])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before) and ``ids`` (little-endian unsigned 32-bit) of every document in the files."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    heads = blocks.select("shard", "number", "n_ids")
    starts = running_before(heads, [], [("shard", 64), "number"], {"before": ("sum", "n_ids")})
    starts = starts.select("shard", "number", F.coalesce("before", F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("doc_ids", "counts", "start", "block")}
                counts = np.array(row["counts"], dtype=np.int64)
                before = np.cumsum(counts) - counts
                raw = Block(row["block"]).read().tobytes()
                ids = [raw[4 * a : 4 * (a + n)] for a, n in zip(before.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + before, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    joined = blocks.join(starts, ["shard", "number"]).select("doc_ids", "counts", "start", "block")
    return joined.mapInArrow(run, "doc_id long, start long, ids binary")
