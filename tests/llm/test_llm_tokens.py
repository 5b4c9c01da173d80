"""Token ids: pieces against the sentencepiece library, compressed files against the tokenizers library."""

from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from corpus_cases import TEXTS, awkward, empty, row
from tokenizers import Tokenizer

from gavelspark.llm import grammar, pieces
from gavelspark.llm.plans import END_ID, PIECE_MODEL, WORD_TOKENIZER

ALPHABET = "ab  \n\t▁éñ中🙂‍\x00<s>0x1\ŕzqthe ing"


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def source():
    with open(WORD_TOKENIZER, "rb") as file:
        return file.read()


def test_chance_texts_equal_the_library(model, library):
    rng, mine, back = random.Random(3), pieces.Pieces(model), pieces.Decoder(model)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(n)) for n in (0, 1, 2, 5, 30, 300) for _ in range(40)]
    for text, found, decoded in zip(texts, *mine.encode_and_decode(texts)):
        ids = np.frombuffer(found, "<i4").tolist()
        assert ids == library.encode(text) and decoded == back.decode(ids) == library.decode(ids)


def test_heap_and_rounds_agree(model):
    rng, mine = random.Random(5), pieces.Pieces(model, check=False)
    chunks = [" " + "".join(rng.choice("theringsand.,éq🙂") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert mine._rounds(chunks) == [mine.agenda(chunk) for chunk in chunks]


def test_a_wrong_encoding_is_found(model):
    mine = pieces.Pieces(model)
    mine.pair_keys = np.array([-1])
    with pytest.raises(ValueError):
        mine.encode(["the thing"])


def test_encode_and_decode_rows(spark, model, library):
    both = pieces.decode(pieces.encode(awkward(spark), model), model).collect()
    assert len(both) == len(TEXTS) + 4
    known = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both)
    texts = [*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[1]), (None, None), (8, "another text of the same id")]
    wanted = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in texts)
    assert known == wanted
    at_once = pieces.encode(awkward(spark), model, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in at_once) == wanted
    assert pieces.encode(empty(spark), model).count() == 0


def test_a_task_takes_little_memory(spark, model, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshr", k=7)) for _ in range(8_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1_500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    docs = empty(spark)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: task)
    task = pieces.encode(docs, model, decoded=True, reuse=False)
    tracemalloc.start()
    try:
        # the tables of the model are there with the first row
        found = task(iter([batch.slice(0, 1), batch]))
        rows = next(found).num_rows
        tracemalloc.reset_peak()
        least = tracemalloc.get_traced_memory()[0]
        rows += sum(out.num_rows for out in found)
        most = tracemalloc.get_traced_memory()[1] - least
    finally:
        tracemalloc.stop()
    assert rows == len(texts) + 1 and most < 32e6


def test_words_equal_the_library(source):
    words, library = grammar.WordTokenizer(source), Tokenizer.from_str(source.decode())
    texts = ["a\tb  c\r\nd", "don't I'll", "é é ́x", "<|endoftext|> x<|startoftext|>y", "İΣ Σ", "中文 字", "", " ", "🙂‍🙂 ﬁ"]
    texts += ["Word. WORD, word!! wORD", "it's, x' x'. 's. don't...", "H\u0331. h\u0331 \u0130. Stra\u00dfe### \u00dcber,", "<|ENDOFTEXT|>. <|endoftext|>.", "a1. 9, _x_ x_. a\t. b\u00a0c."]
    rng, pieces_of = random.Random(3), ["a", "Be", "'s", "'", ".", ",", "!?", " ", "\n", "\t", "9", "\u00e9", "E\u0301", "<|", "|>", "\u4e2d", "_", "\u0301", "K\u212a"]
    texts += ["".join(rng.choices(pieces_of, k=rng.randrange(1, 40))) for _ in range(500)]
    for text, found in zip(texts, words.encode(texts)):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("ids", [
    [], [7], [1, 1, 1, 1, 1] * 50, [1, 2] * 400, [70_000, 3] * 100, [0] * 999,
    [random.Random(1).randrange(20) for _ in range(5000)],
])
def test_blocks_round_trip(ids):
    block = grammar.Block(grammar.compress(np.array(ids, dtype="<u4"), least_count=2))
    assert block.read().tolist() == ids and len(block) == len(ids)
    rng = random.Random(2)
    for _ in range(30):
        a, b = sorted((rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 1)))
        assert block.read(a, b).tolist() == ids[a:b]


def test_pairs_are_replaced():
    ids = np.array([1, 2, 3, 4] * 1000, dtype="<u4")
    block = grammar.Block(grammar.compress(ids))
    assert len(block.rules) >= 3 and len(block.sequence) < 500 and block.lengths.max() >= 4


def test_all_pairs_are_counted():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 60_000).clip(max=70_000).astype("<u4")
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]
    counts = Counter(pairs.tolist())
    wanted = sorted((p for p, n in counts.items() if n >= 5), key=lambda p: (-counts[p], p))
    assert grammar._frequent(pairs, 5, 1 << 20).tolist() == wanted
    assert grammar._frequent(pairs, 5, 10).tolist() == wanted[:10]
    # rounds go on until no pair is left that occurs so often, past 65,536 symbols too
    block = grammar.Block(grammar.compress(ids, round_pairs=50, least_count=5))
    left = Counter(zip(block.sequence[:-1].tolist(), block.sequence[1:].tolist()))
    assert max(left.values()) < 5 and block.read().tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packed_numbers(bits):
    numbers = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    raw = b"x" + grammar.pack(numbers, bits)
    found, stop = grammar.unpack(raw, 1, len(numbers), bits)
    assert found.tolist() == numbers.tolist() and stop == len(raw)


@pytest.mark.parametrize("block_ids", [1 << 20, 300])
def test_files(spark, folder, source, block_ids):
    docs, library = awkward(spark), Tokenizer.from_str(source.decode())
    grammar.write(docs, source, END_ID, f"{folder}/blocks", block_ids=block_ids)
    got = grammar.read(spark, f"{folder}/blocks").collect()
    texts = [*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[1]), (None, None), (8, "another text of the same id")]
    ids = lambda text: np.array([*library.encode(text or "", add_special_tokens=False).ids, END_ID], dtype="<u4").tobytes()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, ids(t)) for i, t in texts)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    if block_ids < 1000:
        assert spark.read.parquet(f"{folder}/blocks").count() >= 3


def test_no_documents_no_blocks(spark, folder, source):
    grammar.write(empty(spark), source, END_ID, f"{folder}/none")
    assert grammar.read(spark, f"{folder}/none").count() == 0


def test_crc_of_the_bytes(spark, folder, source):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([row(3, "hello world")], "doc_id long, text string, lang string, digest string, row int, number string, doc long, _1 string, n_chars long")
    grammar.write(docs, source, END_ID, f"{folder}/one")
    found = grammar.read(spark, f"{folder}/one").select("ids", F.crc32("ids").alias("crc")).first()
    assert found.crc == zlib.crc32(bytes(found.ids))
