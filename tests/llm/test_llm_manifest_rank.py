"""The manifest, ranked search and covering fingerprints, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log

import numpy as np
import pytest
from corpus_cases import TEXTS, awkward, documents, empty, prose
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gavelspark.llm import covering, fptree, manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# manifest

def plain_proofs(leaves):
    """Per leaf its siblings in a row, its tree's top and the root; ``leaves`` are (tree, order, digest)."""
    h = lambda text: sha256(text.encode()).hexdigest()

    def tree_of(digests):
        proofs, owners = [[] for _ in digests], [[i] for i in range(len(digests))]
        while len(digests) > 1:
            runs = [list(range(i, min(i + 16, len(digests)))) for i in range(0, len(digests), 16)]
            for run in runs:
                for i in run:
                    for leaf in owners[i]:
                        proofs[leaf] += [digests[j] for j in run if j != i]
            owners = [sum((owners[i] for i in run), []) for run in runs]
            digests = [h("".join(digests[i] for i in run)) for run in runs]
        return proofs, digests[0]

    by_tree = defaultdict(list)
    for tree, order, digest in leaves:
        by_tree[tree].append((order is not None, order, digest))
    names = sorted(by_tree, key=lambda name: (name is not None, (name or "").encode()))
    lower, tops = {}, []
    for name in names:
        own = sorted(by_tree[name])
        lower[name] = own, *tree_of([digest for *_, digest in own])
        tops.append(lower[name][2])
    upper, root = tree_of(tops)
    return Counter(
        (name, order, digest, "".join(proof + above), top, root)
        for name, above in zip(names, upper)
        for own, proofs, top in [lower[name]]
        for (_, order, digest), proof in zip(own, proofs)
    )


def proved(df, tree="source", order=("doc_id",)):
    found = manifest.prove(df, tree, order)
    rows = found.select(tree, order[0], "leaf", manifest.siblings(F.col("steps")).alias("proof"), "subroot", "root", manifest.fold(F.col("leaf"), F.col("steps")).alias("folded")).collect()
    assert all(r.folded == r.root for r in rows)
    return Counter(tuple(r)[:6] for r in rows)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [4096, 40], [4097, 16, 1, 300], [2] * 40])
def test_proofs_equal_plain_ones(spark, sizes):
    rows = [(None if t == 1 else f"s{t}", i * 7 % 5003, sha256(f"{t} {i}".encode()).hexdigest()) for t, size in enumerate(sizes) for i in range(size)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(4)
    assert proved(df) == plain_proofs(rows)


def test_proofs_of_awkward_rows(spark):
    # null ids and keys, an id that is there with another text, rows that are there twice, other columns by the new names
    docs = awkward(spark).withColumn("leaf", manifest.digest_of(F.col("doc_id"), F.col("lang"), F.col("text"))).withColumn("source", F.when(F.col("doc_id") > 5, F.lit("é")).when(F.col("doc_id") < 3, F.lit("z")))
    docs = docs.withColumn("root", F.lit("x")).withColumn("steps", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("at", F.lit(0))
    rows = [(r.source, r.doc_id, r.leaf) for r in docs.collect()]
    assert proved(docs) == plain_proofs(rows)
    assert set(manifest.prove(docs).columns) == set(docs.columns) | {"subroot"}
    by_id = {r.doc_id: r.leaf for r in docs.collect()}
    long = TEXTS[9].encode()
    assert by_id[9] == sha256(b"1:92:en" + str(len(long)).encode() + b":" + long).hexdigest()
    assert by_id[4] == sha256(b"1:4--").hexdigest() and by_id[5] == sha256(b"1:52:en0:").hexdigest()
    assert manifest.prove(empty(spark).withColumn("leaf", F.lit("a")).withColumn("source", F.lit("a"))).count() == 0


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [("a", i, sha256(str(i).encode()).hexdigest()) for i in range(50)]
    found = manifest.prove(spark.createDataFrame(rows, "source string, doc_id long, leaf string"))
    other = manifest.fold(F.when(F.col("doc_id") % 7 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")), F.col("steps"))
    assert {r.doc_id for r in found.filter(other != F.col("root")).collect()} == {i for i in range(50) if i % 7 == 0}


def test_the_queue_delivers_in_label_order():
    digests = [sha256(str(i).encode()).hexdigest() for i in range(300)]
    top, records = manifest.forward(digests, 3)
    labels = [label for label, _ in records]
    assert labels == sorted(labels) and labels[-1] == (299, 3) and len(set(labels)) == len(labels)
    steps = manifest.backward(300, 3, records, [("l", "r")])
    for digest, own in zip(digests, steps):
        assert len(own) == 4 and own[-1] == ("l", "r")
        for before, after in own[:-1]:
            digest = sha256((before + digest + after).encode()).hexdigest()
        assert digest == top
    assert manifest.forward(["x"], 0) == ("x", []) and manifest.backward(1, 0, [], [("a", "b")]) == [[("a", "b")]]


# ranked search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    """Docs and items are (id, text) rows."""
    split = [(i, Counter(terms(text))) for i, text in docs]
    split = [(i, own) for i, own in split if own]
    n_docs, n_terms = len(split), sum(sum(own.values()) for _, own in split)
    holders = Counter(term for _, own in split for term in own)
    out = Counter()
    for item, text in items:
        scored = []
        for i, own in split:
            m = 10 + 90 * sum(own.values()) * n_docs // n_terms
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in set(terms(text)) if own[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for place, (score, unnamed, i) in enumerate(sorted(scored)[:k], 1):
            out[(item, place, None if unnamed else i, -score)] += 1
    return out


def ranking(docs, items, **options):
    return Counter(tuple(r) for r in fptree.rank(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


ITEMS = "item_id long, text string, digest string, rank int"


@pytest.mark.parametrize("options", [{}, {"group_terms": 12}, {"block_bytes": 300, "k": 3}], ids=["one tree", "small trees", "blocks"])
def test_ranking_equals_brute_force(spark, options):
    texts = prose(150, 51)
    texts += texts[:20] * 2
    rng = random.Random(3)
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(" "), 6))) for i in range(30)]
    items += [(3, texts[0]), (4, "no0such1word"), (5, ""), (6, None), (None, texts[1]), (7, items[7][1])]
    asked = spark.createDataFrame([(i, text, "x", 1) for i, text in items], ITEMS)
    k = options.get("k", 10)
    assert ranking(documents(spark, texts), asked, **options) == plain_ranking(list(enumerate(texts)), items, k)


def test_ranking_of_awkward_documents(spark):
    docs = awkward(spark)
    items = [(1, "The CAT, one word of another moon"), (2, "1234 ñandú größe"), (3, "word 5678"), (4, "!!!")]
    asked = spark.createDataFrame([(i, text, "x", 1) for i, text in items], ITEMS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ranking(docs, asked) == plain_ranking(rows, items)
    assert fptree.rank(empty(spark), asked).count() == 0 and fptree.rank(docs, asked.limit(0)).count() == 0
    assert fptree.rank(docs, asked.filter("item_id = 4")).schema["item_id"].dataType == asked.schema["item_id"].dataType


def test_bounds_leave_out_documents():
    """Few documents hold the rare terms of a query: the others are not scored, and the result is the same."""
    rng = np.random.default_rng(1)
    docs, width = 2000, 40
    holds = rng.random((docs, width)) < np.linspace(0.9, 0.01, width)
    holds[:, 0] = True
    doc, column = np.nonzero(holds)
    tf = rng.integers(1, 5, len(doc))
    m = rng.integers(50, 150, docs)
    holders = Counter(column.tolist())
    group = fptree.Group([(0, [3, 39]), (1, [38]), (2, list(range(5)))], holders, docs)
    order = {int(t): i for i, t in enumerate(group.terms)}
    own = np.isin(column, group.terms)
    tree = fptree.Tree(doc[own], np.array([order[c] for c in column[own].tolist()]), tf[own], m, len(group.terms))
    best = fptree.Best(3)
    fptree.search(tree, group, list(range(docs)), best)
    table = np.zeros((docs, width), dtype=np.int64)
    table[doc, column] = tf
    for query, asked in enumerate([[3, 39], [38], list(range(5))]):
        scores = sum(fptree.weight(holders[t], docs) * fptree.contribution(table[:, t], m) for t in asked)
        wanted = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:10]
        assert sorted((-s, -low) for s, _, low in best.rows[query]) == wanted
    assert best.scored < 0.5 * 3 * docs


def test_nodes_bound_their_documents():
    rng = np.random.default_rng(2)
    doc, column = np.nonzero(rng.random((300, 12)) < 0.4)
    tf, m = rng.integers(1, 9, len(doc)), rng.integers(20, 300, 300)
    tree = fptree.Tree(doc, column, tf, m, 12, 4)
    stack, ends = [tree.root], []
    while stack:
        node = stack.pop()
        table = tree.table(node.low, node.high)
        assert (table.max(axis=0) == node.most).all() and tree.m[node.low : node.high].min() == node.least_m
        if node.children:
            assert [c.low for c in node.children] == [node.low, *[c.high for c in node.children[:-1]]] and node.children[-1].high == node.high
            stack += node.children
        else:
            ends.append(node.high - node.low)
    assert sum(ends) == 300 and max(ends) <= 4


# covering fingerprints

def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Root of each fingerprint."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    return {p: find(p) for p in prints}


def wanted_classes(rows, radius=2):
    prints = [(i, plain_print(text)) for i, text in rows]
    root = plain_components([p for _, p in prints], radius)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)


def found_classes(docs, **options):
    return Counter(tuple(r) for r in covering.classes(docs, **options).select("doc_id", covering.hex_digits(F.col("fingerprint")), "component_id").collect())


@pytest.mark.parametrize("bucket", [64, 1])
def test_covering_classes_equal_brute_force(spark, bucket):
    rng = random.Random(9)
    texts = prose(150, 61, 40, 300)
    for text in texts[:60]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    wanted = wanted_classes(list(enumerate(texts)))
    assert any(i != least for i, _, least in wanted)
    assert found_classes(documents(spark, texts), bucket=bucket) == wanted


def test_covering_classes_of_awkward_documents(spark):
    docs = awkward(spark)
    got = found_classes(docs)
    assert got == wanted_classes([(r.doc_id, r.text) for r in docs.collect()])
    # texts without a word are alike
    assert {least for i, p, least in got if p == "0" * 16} == {4}
    assert covering.classes(empty(spark)).count() == 0
    nameless = docs.filter("doc_id is null")
    assert {r.component_id for r in covering.classes(nameless).collect()} == {None}


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("bucket", [1000, 1])
def test_links_reach_all_pairs(spark, radius, bucket):
    """Around a few centres, some pairs just within the radius and some just beyond; small buckets and large ones."""
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for n in range(1, 6):
            for _ in range(3):
                prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in covering.links(df, radius, bucket).collect()]
    assert pairs and all(0 < (a ^ b).bit_count() <= radius for a, b in pairs)
    want = plain_components(prints, radius)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len({find(p) for p in prints}) == len(set(want.values()))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = covering.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 28
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not mask & bits for mask in masks)


def test_votes_of_long_texts_are_counted_in_parts():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 150_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150_000, dtype=np.uint64)
    counts = np.array([0, 3, 140_000, 0, 9_997, 0])
    got, at = covering.majority(hashes, counts), 0
    for found, n in zip(got.tolist(), counts.tolist()):
        own = hashes[at : at + n]
        at += n
        assert found == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)


def test_one_print_in_a_third_of_the_rows(spark):
    texts = ["the same text of many rows in this table"] * 400 + prose(100, 71)
    got = found_classes(documents(spark, texts), bucket=1)
    assert got == wanted_classes(list(enumerate(texts)))


