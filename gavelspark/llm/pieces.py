"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes pieces by merging adjacent symbols: of all adjacent pairs whose
concatenation is a piece, the one of the best score is merged next, the leftmost first among
equals. The pairs wait in an agenda ordered by score. No piece has a space mark after another
character, and a character that is in no piece merges with nothing, so a text falls into
chunks that merge on their own. Chunks repeat: each Python worker keeps a bounded number of
them. Texts are taken in slices of a megabyte, as their chunks are many times as large in
Python. New chunks of a slice go through the agenda together: short ones in arrays, where every
round pops the best pair of every chunk, long ones through a heap. Each new chunk is also given
to the sentencepiece library, slice by slice, and a difference ends the task.

The work is one pass over the rows, without a shuffle; a lost task is run again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gavelspark.llm.rows import Generations, built_once, id_and_text, slices, texts_of

# The mark that stands for a space, and the replacement of undecodable bytes.
SPACE = "▁"

# Characters of a chunk beyond which it goes through the heap.
LONG_CHUNK = 64
# Chunks that a worker keeps from task to task, and those of a table that goes with its task:
# about 150 bytes each, and up to twice as many for a while.
CACHED_CHUNKS = 450_000
TASK_CHUNKS = 200_000
# Bytes of text encoded at a time: their chunks, lists and numbers take some twenty times that.
SLICE_BYTES = 1 << 20
_NEVER = np.iinfo(np.int32).max


class OddIds(bytes):
    """Ids that decode to another ``text`` than they were made of."""

    text: str


class Pieces:
    """The pieces of a merge-type model: encoding, decoding, and the library as a check."""

    def __init__(self, model: bytes, check: bool = True, cached: int = CACHED_CHUNKS) -> None:
        library = self.library = SentencePieceProcessor(model_proto=model)
        self.check = check
        self.size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(self.size)]
        if any(SPACE in name.lstrip(SPACE) or " " in name for name in names):
            raise ValueError("the vocabulary has pieces that reach over a space; chunks would not be independent")
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(self.size)]
        # within this class a space stands for its mark
        plain = {name.replace(SPACE, " "): i for i, name in enumerate(names) if not special[i]}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(self.size) if library.is_byte(i)}
        self.unknown = library.unk_id()
        # symbols are pieces and the characters of pieces
        self.symbols = dict(plain)
        for name in plain:
            for character in name:
                self.symbols.setdefault(character, self.size + len(self.symbols))
        self.stride = self.size + 2 * len(self.symbols)
        best = sorted({library.get_score(i) for i in plain.values()}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(best)}
        found = []
        for name, i in plain.items():
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left is not None and right is not None:
                    found.append((left * self.stride + right, rank_of[library.get_score(i)], i))
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self._pairs: dict[int, tuple[int, int]] = {}
        self.of_character = np.full(0x110000, -1, dtype=np.int32)
        for name, symbol in self.symbols.items():
            if len(name) == 1:
                self.of_character[ord(name)] = symbol
        self.chunk = re.compile("\n| +[^ \n]*|[^ \n]+" if "\n" not in self.symbols else " +[^ ]*|[^ ]+")
        self.cache = Generations(cached)
        self.decoder, self.odd = Decoder(model), False

    # encoding

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(" " + text.replace(SPACE, " ")) if text else []

    @property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol by pair, for the heap."""
        if not self._pairs:
            self._pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_merged.tolist())))
        return self._pairs

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return self.encode_and_decode(texts)[0]

    def encode_and_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids of each text, and the texts that they decode to."""
        chunked = [self.chunks(text) for text in texts]
        new = self.cache.missing(set().union(*chunked))
        if new:
            ids = self._encode_new(new)
            if self.check:
                self._compare(new, ids)
            self.cache.new.update(zip(new, self._decoded(new, ids)))
        known = self.cache.new
        found = [[known[chunk] for chunk in chunks] for chunks in chunked]
        if self.odd:
            chunked = [[getattr(ids, "text", chunk) for chunk, ids in zip(chunks, own)] for chunks, own in zip(chunked, found)]
        return [b"".join(ids) for ids in found], ["".join(chunks).removeprefix(" ") for chunks in chunked]

    def _decoded(self, chunks: list[str], ids: list[bytes]) -> list[bytes]:
        """The ids of new chunks, decoded once: those that give another text than the chunk keep it."""
        pieces = self.decoder.bytes
        flat = np.frombuffer(b"".join(ids), "<i4")
        text = [pieces[i] for i in flat.tolist()]
        ends = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)
        sizes = np.diff(np.r_[0, np.r_[0, np.cumsum(np.fromiter(map(len, text), dtype=np.int64, count=len(text)))][ends]])
        wanted = [chunk.encode() for chunk in chunks]
        if b"".join(text) == b"".join(wanted) and np.array_equal(sizes, np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted))):
            return ids
        out = []
        for chunk, raw in zip(chunks, ids):
            back = b"".join([pieces[i] for i in np.frombuffer(raw, "<i4").tolist()]).decode("utf-8", errors="replace")
            if back != chunk:
                raw = OddIds(raw)
                raw.text, self.odd = back, True
            out.append(raw)
        return out

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        short = [i for i, chunk in enumerate(chunks) if len(chunk) <= LONG_CHUNK]
        out: list[bytes | None] = [None] * len(chunks)
        for i, ids in zip(short, self._rounds([chunks[i] for i in short])):
            out[i] = ids
        return [self.agenda(chunk) if ids is None else ids for chunk, ids in zip(chunks, out)]

    def agenda(self, chunk: str) -> bytes:
        """One chunk through a heap of pairs."""
        ids = [self.symbols.get(character, -1) for character in chunk]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if ids[i] >= 0 and ids[j] >= 0 and (pair := self.pairs.get(ids[i] * self.stride + ids[j])):
                heapq.heappush(heap, (pair[0], i, j, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, left, right = heapq.heappop(heap)
            if ids[i] != left or ids[j] != right or after[i] != j:
                continue
            ids[i], ids[j] = self.pairs[left * self.stride + right][1], -2
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array(self._spelled(((s, chunk[i]) for i, s in enumerate(ids) if s != -2)), dtype="<i4").tobytes()

    def _spelled(self, symbols: Iterator[tuple[int, str]]) -> list[int]:
        """Piece ids; a character without a piece becomes its bytes, or the unknown id."""
        out: list[int] = []
        for symbol, character in symbols:
            if 0 <= symbol < self.size:
                out.append(symbol)
            elif self.byte_ids:
                out.extend(self.byte_ids[value] for value in character.encode())
            else:
                out.append(self.unknown)
        return out

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.stride + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], _NEVER), self.pair_merged[at]

    def _rounds(self, chunks: list[str]) -> list[bytes]:
        """Short chunks, all together: a round merges the best pair of every chunk."""
        if not chunks:
            return []
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        symbol, origin = self.of_character[codes], np.arange(len(codes))
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        # rank and merged symbol of the pair that starts at each place
        rank, merged = np.full(len(codes), _NEVER, dtype=np.int32), np.zeros(len(codes), dtype=np.int32)
        if len(codes) > 1:
            rank[:-1], merged[:-1] = self._looked_up(symbol[:-1], symbol[1:])
            rank[:-1][chunk[1:] != chunk[:-1]] = _NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.r_[True, chunk[1:] != chunk[:-1]]
            local = np.cumsum(first) - 1
            best = np.minimum.reduceat(rank, np.flatnonzero(first))
            ended = (best == _NEVER)[local]
            if ended.any():
                done.append((symbol[ended], origin[ended]))
                symbol, origin, chunk, rank, merged, local = (x[~ended] for x in (symbol, origin, chunk, rank, merged, local))
                if not len(symbol):
                    break
            popped = np.flatnonzero(rank == best[local])
            where = local[popped]
            popped = popped[np.r_[True, where[1:] != where[:-1]]]
            symbol[popped] = merged[popped]
            keep = np.ones(len(symbol), dtype=bool)
            keep[popped + 1] = False
            place = (np.cumsum(keep) - 1)[popped]
            symbol, origin, chunk, rank, merged = (x[keep] for x in (symbol, origin, chunk, rank, merged))
            changed = np.r_[place[place > 0] - 1, place[place < len(symbol) - 1]]
            rank[place[place == len(symbol) - 1]] = _NEVER
            rank[changed], merged[changed] = self._looked_up(symbol[changed], symbol[changed + 1])
            rank[changed[chunk[changed] != chunk[changed + 1]]] = _NEVER
        symbols, origins = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        order = np.argsort(origins)
        symbols, origins = symbols[order], origins[order]
        ends = np.searchsorted(origins, np.cumsum(lengths))
        starts = np.r_[0, ends[:-1]]
        odd = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.cumsum((symbols < 0) | (symbols >= self.size), out=odd[1:])
        odd = odd[ends] > odd[starts]
        raw = symbols.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        for i in np.flatnonzero(odd).tolist():
            found, places = symbols[starts[i] : ends[i]].tolist(), origins[starts[i] : ends[i]].tolist()
            out[i] = np.array(self._spelled((s, chr(codes[p])) for s, p in zip(found, places)), dtype="<i4").tobytes()
        return out

    def _compare(self, chunks: list[str], ids: list[bytes]) -> None:
        """The library's ids of the same chunks; a line feed before a chunk keeps it from getting a space mark."""
        lead = len(self.library.encode("\n"))
        wanted = self.library.encode(["\n" + chunk for chunk in chunks], num_threads=1)
        flat = np.fromiter(chain.from_iterable(wanted), dtype="<i4")
        lengths = np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted))
        shields = (np.cumsum(lengths) - lengths)[:, None] + np.arange(lead)
        same = np.array_equal(lengths - lead, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)
        if not same or np.delete(flat, shields.ravel()).tobytes() != b"".join(ids):
            odd = next(c for c, mine, want in zip(chunks, ids, wanted) if np.array(want[lead:], dtype="<i4").tobytes() != mine)
            raise ValueError(f"the library encodes {odd!r} in another way")


class Decoder:
    """What each piece stands for in a text; control pieces stand for nothing."""

    def __init__(self, model: bytes) -> None:
        library = SentencePieceProcessor(model_proto=model)
        self.bytes = [
            bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i)
            else b"" if library.is_control(i) or library.is_unused(i)
            else " \u2047 ".encode() if library.is_unknown(i)
            else library.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(library.get_piece_size())
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space mark goes, undecodable bytes are replaced."""
        known = self.bytes
        text = b"".join([known[i] for i in ids])
        return text.removeprefix(b" ").decode("utf-8", errors="replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", check: bool = True, decoded: bool = False, reuse: bool = True,
) -> DataFrame:
    """``doc_id`` and the array ``ids`` of every text; nothing is put before or after. With
    ``decoded`` also the text that ``decode`` gives for the ids, in the same pass.

    Null and the empty text have no ids. Rows are encoded on their own, so ties, repeated rows
    and null ids stay as they are; other columns are ignored. ``check`` compares with the
    library. ``model`` is the content of the model file, which is the same at every scale. With
    ``reuse`` a Python worker keeps its table of chunks for later tasks; without, the table is smaller and goes with the task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = built_once(Pieces, shipped.value, check) if reuse else Pieces(shipped.value, check, TASK_CHUNKS)
        for batch in slices(batches, "text", SLICE_BYTES):
            found, texts = pieces.encode_and_decode(texts_of(batch, "text"))
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"), type=pa.int32())
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values)]
            if decoded:
                columns.append(pa.array(texts, type=pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return id_and_text(docs, id_column, text_column).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """The rows with the text of their ids. Null ids give a null text, no ids the empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)
    at = encoded.columns.index(ids_column)
    kept = encoded.drop(text_column)
    schema = kept.select("*", F.lit("").alias(text_column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = built_once(Decoder, shipped.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [None if ids is None else pieces.decode(ids) for ids in part.column(ids_column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())], names=[*part.schema.names, text_column])

    assert at >= 0
    return kept.mapInArrow(run, schema)
