"""Operators that compare texts and vectors, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from corpus_cases import TEXTS, awkward, documents, empty, prose, row
from pyspark.sql import functions as F

from gavelspark.llm import chunks, components, decontam, maxscore, partenum, templates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id long, text string, digest string"


# benchmark passages

def plain_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, names = set(), set()
    for name, raw in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (raw or "").translate(LOWER))
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
    return len(words), len(hit), names


ITEMS = [
    (10, "The cat sat on the mat and looked at the moon for a very long"), (2, "sat on the mat and looked at the moon for a very"),
    (3, "one"), (4, "ñandú GRÖSSE"), (5, None), (6, "  !!"), (7, "word word word word word word word word word word word word"),
    (8, "another text of"), (8, "the same id"), (9, "no such passage in any of the documents at all I hope"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_equals_brute_force(spark, block_bytes):
    items = spark.createDataFrame([(i, t, "x") for i, t in [*ITEMS, (None, "one")]], BENCH)
    docs = awkward(spark).filter("doc_id is null or doc_id <> 11")
    got = decontam.search(docs, items, block_bytes=block_bytes).select("doc_id", "n_words", decontam.hit_words(F.col("matches")).alias("hit"), "matches").collect()
    texts = [(i, t) for i, t in TEXTS.items() if i != 11] + [(1, TEXTS[1]), (None, TEXTS[1]), (None, None), (8, "another text of the same id")]
    found = Counter((r.doc_id, r.n_words, r.hit, frozenset(m.item_id for m in r.matches)) for r in got)
    wanted = Counter()
    for i, text in texts:
        n, hit, names = plain_hits(text, ITEMS)
        wanted[(i, n, hit, frozenset(names))] += 1
    assert found == wanted


def test_matches_are_the_longest(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)), "")], BENCH)
    text = "x " + " ".join(f"w{i}" for i in range(5, 30)) + " y " + " ".join(f"w{i}" for i in range(12)) + " z w1 w2 w3"
    rows = decontam.search(documents(spark, [text]), items).first().matches
    assert [(m.doc_word, m.item_word, m.n_words) for m in rows] == [(1, 5, 25), (27, 0, 12)]


def test_affected_documents_go(spark):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS[:2]], BENCH)
    kept = decontam.decontaminate(awkward(spark), items)
    assert kept.columns == awkward(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert not {1, 2, 3} & set(ids) and ids[8] == 2 and ids[None] == 1 and ids[11] == 1
    assert decontam.decontaminate(awkward(spark), items.limit(0)).count() == len(TEXTS) + 4
    assert decontam.decontaminate(empty(spark), items).count() == 0


# vectors

def plain_top(rows, is_query, k=10):
    fine = [(i, [floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if is_query(i)}):
        own = min(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 50}, {"shard_rows": 7}])
def test_top_k_equals_brute_force(spark, options):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(130)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(300, None), (400, [1.0, None]), (500, [float("nan")] * 8), (600, [float("inf")] * 8)]
    rows += [(700, []), (800, [0.5]), (None, [1.0] * 8), (900, [0.0] * 8), (100, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    got = maxscore.top_k(df, F.col("vec_id") % 100 == 0, **options).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(rows, lambda i: i % 100 == 0)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_scores_are_exact():
    names, matrix = np.arange(3), np.array([[2.0**40, 1.0], [2.0**20, 3.0], [-1.0, 2.0]])
    found, scores = maxscore.Shard(names, matrix).best(9, np.array([2.0**20, 1.0]), 2)
    assert found.tolist() == [0, 1] and list(scores) == [2**60 + 1, 2**40 + 3]


def test_pruning_leaves_the_result(spark):
    rng = np.random.default_rng(0)
    matrix = np.floor(rng.normal(0, 200, (4000, 32)))
    shard = maxscore.Shard(np.arange(4000), matrix)
    for q in range(0, 4000, 400):
        names, scores = shard.best(q, matrix[q], 10)
        full = matrix @ matrix[q]
        full[q] = -np.inf
        order = np.lexsort((np.arange(4000), -full))[:10]
        assert names.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


@pytest.mark.parametrize("share", [0.01, 0.05, 0.3])
def test_sparse_postings_leave_the_result(share):
    rng = np.random.default_rng(1)
    matrix = np.floor(rng.normal(0, 200, (3000, 256))) * (rng.random((3000, 256)) < share)
    matrix[5], matrix[7] = 0, matrix[100]
    shard = maxscore.Shard(np.arange(3000), matrix)
    queries = [*range(0, 3000, 100), 5]
    for q in queries:
        names, scores = shard.best(q, matrix[q], 10)
        full = matrix @ matrix[q]
        full[q] = -np.inf
        order = np.lexsort((np.arange(3000), -full))[:10]
        assert names.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    # few vectors are in a posting of an essential term
    assert share > 0.05 or shard.begun < 0.3 * 3000 * len(queries)


# near duplicates

def plain_classes(rows, words=5, percent=75):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in range(len(sets)):
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return Counter((i, len(s), low[i]) for i, s in sets) + Counter((None, len(shingles(t)), None) for i, t in rows if i is None)


@pytest.mark.parametrize("seed, least, most", [(1, 1, 8), (2, 5, 30), (3, 20, 200), (4, 100, 900)])
def test_classes_equal_brute_force(spark, seed, least, most):
    texts = prose(120, seed, least, most)
    got = partenum.classes(documents(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(list(enumerate(texts)))


def test_classes_in_small_blocks(spark):
    texts = prose(80, 7, 30, 60)
    got = partenum.classes(documents(spark, texts), block_shingles=100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(list(enumerate(texts)))


def test_classes_of_copies_in_many_blocks(spark):
    """One group of near copies over some twenty blocks, of which a few are like few others only."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        # a chain of ever longer tails leads away from the group
        texts.append(" ".join(words + [f"t{k}" for k in range(20 * (i - 150))]))
    got = partenum.classes(documents(spark, texts), block_shingles=2500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(list(enumerate(texts)))


def test_classes_of_chance_in_many_blocks(spark):
    """Unlike texts that stock phrases tie into one candidate class."""
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(400)]
    texts = []
    for i in range(400):
        own = [f"d{i}w{j}" for j in range(10)]
        texts.append(" ".join([phrases[i], *own, phrases[(i + 1) % 400]]))
    texts += [texts[k] + " and more" for k in rng.sample(range(400), 40)]
    got = partenum.classes(documents(spark, texts), block_shingles=1000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(list(enumerate(texts)))


def test_classes_tied_by_chance_are_cut_before_sets_are_compared(spark, monkeypatch):
    """Sets go to one block: of the candidates that stock phrases tie together only near copies are left."""
    phrases = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(120)]
    rows = [(i, " ".join([phrases[i], *(f"d{i}w{j}" for j in range(10)), phrases[(i + 1) % 120]])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " and more") for i in range(0, 120, 5)]
    # ids of two texts, of which one has a near copy
    rows += [(1, rows[63][1] + " and yet more"), (2, None), (64, rows[64][1])]
    seen, verified = [], partenum._verified
    monkeypatch.setattr(partenum, "_verified", lambda *args: seen.append(args[1]) or verified(*args))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = partenum.classes(docs, block_shingles=500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(rows)
    members = seen[0].collect()
    assert {r.blocks for r in members} == {1}
    assert {200 + i for i in range(0, 120, 5)} <= {r.doc for r in members} and len(members) < 60


def test_classes_of_awkward_documents(spark):
    rows = [*TEXTS.items(), (1, TEXTS[1]), (8, "another text of the same id"), (None, TEXTS[1]), (None, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in partenum.classes(awkward(spark)).collect())
    assert got == plain_classes(rows)
    assert partenum.classes(empty(spark)).count() == 0
    tied = documents(spark, ["a b c d e f g h", "k l m n o p q r", "k l m n o p q r"]).union(documents(spark, ["k l m n o p q r"]))
    assert {r.doc_id: r.component_id for r in partenum.classes(tied).collect()} == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_similar_sets_share_enough_signatures(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 40), 63, 64, 100, 150, 255, 256, 700, 3000]:
        for _ in range(6):
            base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = rng.integers(0, len(base) // 3 + 1)
            new = rng.integers(0, 1 << 63, rng.integers(0, len(base) // 3 + 1), dtype=np.uint64)
            other = np.unique(np.r_[rng.permutation(base)[gone:], new])
            common = len(np.intersect1d(base, other))
            if not common or 100 * common < percent * (len(base) + len(other) - common):
                continue
            shared = np.intersect1d(partenum.signatures(base, percent), partenum.signatures(other, percent))
            tag = max(len(base), len(other)).bit_length() - 1
            least = min(partenum.spare(len(base), tag), partenum.spare(len(other), tag))
            short = set(shared.view(np.int64).tolist()) & set(partenum.FALLBACKS)
            assert len(shared) >= least + 1 or short
            # no more is asked of a set than what each similar one shares with it
            for n in (len(base), len(other)):
                few = partenum.SINGLE_SPARE if n * 100 // percent < 64 else partenum.SPARE
                assert n * percent // 100 // few <= least or short


def test_word_hashes_over_pieces(monkeypatch):
    raw = ("alpha beta\x0bGAMMA \t\n delta " * 50 + "x" * 300 + " end").encode()
    whole = partenum.word_hashes(raw)
    monkeypatch.setattr(partenum, "_PIECE", 64)
    parts = partenum.word_hashes(raw)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(whole[0]) == len(raw.split()) and len(set(whole[1].tolist())) == 6


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {x: x for link in links for x in link if x is not None}
    for _ in range(100):
        for a, b in links:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    assert got == {n: c for n, c in low.items() if n != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# chunks

def plain_borders(raw, reach, longest):
    """The definition, byte by byte."""
    hashes, h = [], 0
    for byte in bytes(64) + raw:
        h = (2 * h + int(chunks._GEAR[byte])) & 0xFFFFFFFF
        hashes.append(h)
    hashes = hashes[64:]
    n = len(raw)
    for i in range(n - 1):
        if raw[i + 1] & 0xC0 == 0x80:
            hashes[i] = 0xFFFFFFFF
    ends = [
        i + 1 for i in range(n)
        if hashes[i] < min(hashes[max(0, i - reach) : i], default=0xFFFFFFFF) and hashes[i] <= min(hashes[i + 1 : i + 1 + reach], default=0xFFFFFFFF)
    ]
    out, last = [], 0
    for stop in [*ends, *([n] if n and (not ends or ends[-1] != n) else [])]:
        while stop - last > longest:
            last += longest
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        out.append(stop)
        last = stop
    return out


def test_borders_equal_the_definition():
    raws = [(TEXTS[i] or "").encode() for i in (1, 3, 4, 5, 6, 8, 9, 10, 12, 13)] + [t.encode() for t in prose(10, 3)]
    assert chunks.borders(raws, 20, 128) == [plain_borders(raw, 20, 128) for raw in raws]


def test_insertions_move_borders_along():
    text = " ".join(prose(1, 5, 400, 400)).encode()
    one, two = chunks.borders([text, b"inserted in front, " + text])
    pieces_of = lambda raw, ends: {raw[a:b] for a, b in zip([0, *ends], ends)}
    both = pieces_of(text, one) & pieces_of(b"inserted in front, " + text, two)
    assert len(both) >= len(one) - 2


def test_repeated_passages_go(spark):
    passage = " ".join(prose(1, 11, 60, 60))
    texts = prose(20, 12, 80, 80)
    mixed = [t if i % 4 else t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :] for i, t in enumerate(texts)]
    rows = {r.doc_id: r for r in chunks.dedup(documents(spark, mixed), least_run=96).collect()}
    assert not rows[0].removed and rows[0].text == mixed[0]
    for i in (4, 8, 12, 16):
        gone = b"".join(mixed[i].encode()[s.start : s.end] for s in rows[i].removed).decode()
        assert rows[i].removed and len(rows[i].text) == len(mixed[i]) - len(gone)
        assert any(gone[j : j + 60] in passage for j in range(0, len(gone) - 60, 10))


def plain_spans(rows, least_run):
    """The removed spans of each document, chunk by chunk in the order of the ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        spans, at, goes_on = [], 0, False
        for stop in plain_borders(raw, chunks.REACH, chunks.LONGEST):
            piece = raw[at:stop]
            if piece in seen and goes_on:
                spans[-1][1] = stop
            elif piece in seen:
                spans.append([at, stop])
            goes_on = piece in seen
            seen.add(piece)
            at = stop
        out[i] = [(a, b) for a, b in spans if b - a >= least_run]
    return out


@pytest.mark.parametrize("least_run", [1, 96])
def test_removed_spans_equal_brute_force(spark, least_run):
    rng = random.Random(21)
    passages = prose(6, 22, 30, 90)
    texts = []
    for text in prose(60, 23, 20, 80):
        words = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words) + 1), rng.choice(passages))
        texts.append(" ".join(words))
    texts += [None, "", texts[3], "word " * 300, "é中" * 400, texts[5] + texts[5]]
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in chunks.dedup(documents(spark, texts), least_run=least_run).collect()}
    assert got == plain_spans(list(enumerate(texts)), least_run)
    assert sum(map(bool, got.values())) > 20


def test_chunks_of_awkward_documents(spark):
    rows = chunks.dedup(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 4
    first = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert first[4].text is None and first[5].text == "" and first[9].text == TEXTS[9]
    # null ids come first, so the copy without an id is the one that stays whole
    assert any(r.doc_id is None and r.text == TEXTS[1] for r in rows)
    assert chunks.dedup(empty(spark)).count() == 0


def test_whole_copies_are_removed_but_for_the_first(spark):
    text = " ".join(prose(1, 13, 100, 100))
    rows = {r.doc_id: r.text for r in chunks.dedup(documents(spark, [text, "a short one", text])).collect()}
    assert rows == {0: text, 1: "a short one", 2: ""}


# line templates

def plain_templates(rows, depth=3, least=3, constant=0.6):
    lines = []
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            masked = re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line)
            if masked.strip(" "):
                lines.append((i, number, masked, (masked.count(" "), tuple(masked.split(" ")[:depth]))))
    docs_of = defaultdict(set)
    for i, _, _, leaf in lines:
        docs_of[leaf].add(i)
    lines = [x for x in lines if len(docs_of[x[3]]) >= least]
    kinds = defaultdict(set)
    for i, _, masked, leaf in lines:
        kinds[leaf, masked].add(i)
    weight = Counter()
    for (leaf, masked), ids in kinds.items():
        for position, token in enumerate(masked.split(" ")):
            weight[leaf, position, token] += len(ids)
    found = defaultdict(list)
    for i, number, masked, leaf in lines:
        fields = [t if t != "<*>" and weight[leaf, p, t] >= least else "<*>" for p, t in enumerate(masked.split(" "))]
        if sum(f != "<*>" for f in fields) >= constant * len(fields):
            found[" ".join(fields)].append((i, number))
    return {(i, number) for spots in found.values() if len({i for i, _ in spots}) >= least for i, number in spots if (i, number) != min(spots)}


def test_templates_equal_brute_force(spark):
    rng = random.Random(6)
    lines = ["Posted on {d} by user{d} in the forum", "Copyright {d} the authors of this page", "All rights reserved.", "Read more about {w} on our site today please", "{w} {w} {w}", ""]
    texts = ["\n".join(rng.choice(lines).replace("{d}", str(rng.randrange(99))).replace("{w}", rng.choice("sun moon tide rain".split())) + rng.choice(["", "", " x"]) for _ in range(6)) for _ in range(40)]
    rows = templates.dedup(documents(spark, texts), least_docs=3).collect()
    got = {(r.doc_id, number) for r in rows for number in r.dropped}
    assert got == plain_templates(list(enumerate(texts))) and got
    for r in rows:
        left = [line for n, line in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, n) not in got]
        assert r.text == "\n".join(left) and r.n_lines == 6


def test_templates_of_awkward_documents(spark):
    rows = templates.dedup(awkward(spark), least_docs=2).collect()
    assert len(rows) == len(TEXTS) + 4
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[4][0].text is None and by_id[5][0].text == "" and not by_id[6][0].dropped
    # a null id comes first; a row that is there twice is one document
    assert [list(r.dropped) for r in by_id[1]] == [[0], [0]] and [list(r.dropped) for r in by_id[2]] == [[0]]
    assert {r.text for r in by_id[None]} == {TEXTS[1], None}
    assert templates.dedup(empty(spark)).count() == 0


def test_recurring_lines_of_fields_by_the_production_values(spark):
    footers = ["Page 3 of 10", "Tel 555 0199 12 44", "Page 4 of 10"]
    texts = [text + "".join("\n" + f for i, f in enumerate(footers) if n % (i + 2) == 0 and n < 6) for n, text in enumerate(prose(12, 29, 9, 30))]
    got = {(r.doc_id, number) for r in templates.dedup(documents(spark, texts)).collect() for number in r.dropped}
    # three texts hold the first line, two the second, two the third
    assert got == plain_verbatim(list(enumerate(texts)), 3) and len(got) == 2
    assert not plain_templates(list(enumerate(texts)), 3, 3, 0.6) & got


def plain_verbatim(rows, least):
    spots = defaultdict(list)
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            if line.strip():
                spots[line].append((i, number))
    texts = dict(rows)
    return {spot for found in spots.values() if len({texts[i] for i, _ in found}) >= least for spot in found if spot != min(found)}


def test_lines_of_few_texts_by_the_production_values(spark):
    rng = random.Random(9)
    own = prose(46, 23, 9, 30)
    shared = {f"A line that {n} texts share {w}": n for n, w in ((2, "alone"), (3, "at least"), (5, "or so"), (19, "nearly"), (30, "or more"))}
    texts = [[own[i]] for i in range(40)]
    for line, n in shared.items():
        for i in rng.sample(range(40), n):
            texts[i].insert(rng.randrange(len(texts[i]) + 1), line)
    for i in range(40):
        texts[i].append(f"Seen {i} times by all of our readers")
    # copies are one text: their own lines stay
    texts = ["\n".join(lines) for lines in texts] + ["copied line\nanother copied line"] * 6 + ["  \n\t\n" + own[i] for i in range(40, 46)]
    rows = list(enumerate(texts))
    got = {(r.doc_id, number) for r in templates.dedup(documents(spark, texts)).collect() for number in r.dropped}
    by_template = plain_templates(rows, 3, 20, 0.6)
    assert got == by_template | plain_verbatim(rows, 3) and got > by_template
    alone = {(r.doc_id, number) for r in templates.dedup(documents(spark, texts), least_texts=None).collect() for number in r.dropped}
    assert alone == by_template


def test_rows_keep_their_columns(spark):
    kept = templates.dedup(documents(spark, ["a b", "c d"])).select("row.*")
    assert kept.columns == awkward(spark).columns and kept.count() == 2 and row(0, "a b") in [tuple(r) for r in kept.collect()]
