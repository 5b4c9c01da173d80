"""Learned operators: language shares and the byte network."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
from corpus_cases import SCHEMA, TEXTS, awkward, empty, row

from gavelspark.llm import bytecnn, langid
from gavelspark.llm.plans import PLANS
from gavelspark.sources.tables import read_table

DATA = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    found = PLANS["op1_language_mixture"](spark, DATA).join(read_table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_shares_of_a_mixed_text(spark):
    model = langid.learn(read_table(spark, DATA, "documents"))
    by_lang = {r.lang: r.text for r in read_table(spark, DATA, "documents").filter("length(text) between 2000 and 4000").collect()}
    text = by_lang["de"][:1500] + "\n" + by_lang["es"][:1500]
    share = dict(zip(model.languages, langid.mixture(model.table, langid.trigrams(text))))
    assert share["de"] > 0.3 and share["es"] > 0.3 and share["en"] + share["fr"] < 0.1
    pure = dict(zip(model.languages, langid.mixture(model.table, langid.trigrams(by_lang["fr"]))))
    assert pure["fr"] > 0.95


def test_shares_are_the_likeliest():
    """Expectation-maximisation against a search over all mixtures of two."""
    rng = np.random.default_rng(1)
    likelihood = rng.random((200, 2)).astype(np.float32) + 0.05
    best = max(np.linspace(0.001, 0.999, 999), key=lambda s: np.log(likelihood @ np.array([s, 1 - s])).sum())
    assert abs(langid.shares(likelihood)[0] - best) < 0.02


def plain_likelihood(likelihood, chosen):
    """The log-likelihood of the best mixture of some languages, by many plain steps."""
    part = likelihood[:, chosen]
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(400):
        held = part * share
        share = (held / held.sum(axis=1, keepdims=True)).mean(axis=0)
    return float(np.log(part @ share).sum()), share


def test_language_sets_have_the_highest_penalised_likelihood():
    """Forward selection against all sets of up to three of five languages."""
    rng = np.random.default_rng(12)
    table = rng.dirichlet(np.full(600, 0.3), size=5).T.astype(np.float32) + np.float32(1e-5)
    table /= table.sum(axis=0)
    seen = Counter()
    for shares in [(1, 0, 0, 0, 0), (0, 0.5, 0.5, 0, 0), (0.7, 0, 0, 0.3, 0), (0, 0.2, 0, 0.3, 0.5), (0, 0, 1, 0, 0), (0.4, 0.3, 0.3, 0, 0)]:
        for n in (60, 400, 1500):
            mixed = table.astype(np.float64) @ np.array(shares)
            found = rng.choice(600, size=n, p=mixed / mixed.sum())
            likelihood = table[found].astype(np.float64)
            tried = {c: plain_likelihood(likelihood, list(c)) for k in (1, 2, 3) for c in combinations(range(5), k)}
            points = {c: gained - langid.PENALTY * np.log(n) * (len(c) - 1) for c, (gained, _) in tried.items()}
            best = max(points, key=points.get)
            got = langid.mixture(table, found)
            chosen = tuple(np.flatnonzero(got).tolist())
            # a set that is all but as good may come first
            assert points[best] - points[chosen] < 1.0, (shares, n, best, chosen)
            assert np.abs(got[list(chosen)] - tried[chosen][1]).max() < 0.05
            seen[len(chosen)] += 1
    assert seen[1] and seen[2] and seen[3]


def test_awkward_texts_have_a_language_or_none(spark):
    model = langid.learn(read_table(spark, DATA, "documents"))
    rows = langid.predict(awkward(spark), model).collect()
    assert len(rows) == len(TEXTS) + 4
    for r in rows:
        text = TEXTS.get(r.doc_id) if r.doc_id not in (8, None) else "x"
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")), r
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.learn(empty(spark))
    assert nothing.languages == () and {r.lang_pred for r in langid.predict(awkward(spark), nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    found = PLANS["op5_byte_network"](spark, DATA).join(read_table(spark, DATA, "labels"), "doc_id")
    rows = found.filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    usual = sum(r.quality for r in rows) / len(rows)
    assert right > max(0.9, usual) and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_answers_in_parts_equal_answers_at_once():
    texts = ["some words, then others. " * 40, "SHOUT!! LOUD!! " * 60] * 6
    network = bytecnn.fit(texts, [1, 0] * 6, epochs=3)
    rows = bytecnn.halves("abc def " * 20_000)
    best, where = bytecnn.answers(network, rows)
    said = network.embed[rows].reshape(len(rows), -1) @ network.filters
    chunk = said[:-1, : bytecnn.FILTERS] + said[1:, bytecnn.FILTERS :]
    assert np.allclose(best, chunk.max(axis=0) + network.bias, atol=1e-5) and (where < len(chunk)).all()


def plain_score(network, text):
    """The convolution as it is defined: every filter at every chunk of two halves, byte by byte."""
    raw = list(text.encode("utf-8"))
    n = max(2, -(-len(raw) // bytecnn.HALF))
    raw += [256] * (n * bytecnn.HALF - len(raw))
    width = bytecnn.HALF * bytecnn.WIDTH
    pooled = []
    for f in range(bytecnn.FILTERS):
        kernel = np.concatenate([network.filters[:width, f], network.filters[:width, bytecnn.FILTERS + f]]).reshape(2 * bytecnn.HALF, bytecnn.WIDTH)
        said = []
        for begin in range(0, (n - 1) * bytecnn.HALF, bytecnn.HALF):
            said.append(sum(float(network.embed[raw[begin + i]] @ kernel[i]) for i in range(2 * bytecnn.HALF)))
        pooled.append(max(0.0, max(said) + float(network.bias[f])))
    return 1 / (1 + np.exp(-(np.dot(pooled, network.weight) + network.offset)))


def test_scores_equal_a_plain_convolution(monkeypatch):
    network = bytecnn.fit(["some words, then others. " * 9, "SHOUT!! LOUD!! " * 9] * 6, [1, 0] * 6, epochs=3)
    rng = random.Random(4)
    texts = ["", "a", "x" * 7, "x" * 8, "é" * 8, "y" * 17, *("".join(rng.choice("abc XYZ!é中\n") for _ in range(n)) for n in (15, 16, 33, 250))]
    for part in (bytecnn._PART, 3):
        monkeypatch.setattr(bytecnn, "_PART", part)
        for text in texts:
            assert abs(bytecnn.score(network, text) - plain_score(network, text)) < 1e-4


def test_gradients_lower_the_loss():
    texts = ["some words, then others. " * 10 + str(i) for i in range(30)] + ["SHOUT!! LOUD!! " * 10 + str(i) for i in range(30)]
    network = bytecnn.fit(texts, [1] * 30 + [0] * 30)
    assert min(bytecnn.score(network, t) for t in texts[:30]) > 0.7 > max(bytecnn.score(network, t) for t in texts[30:])


def test_awkward_texts_have_a_score(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1), (99, 0), (4, 1)], "doc_id long, quality int")
    network = bytecnn.learn(awkward(spark), labels, "quality")
    rows = bytecnn.predict(awkward(spark), network).collect()
    assert len(rows) == len(TEXTS) + 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert bytecnn.predict(empty(spark), network).count() == 0
    alone = bytecnn.learn(awkward(spark), labels.filter("quality = 1"), "quality")
    assert bytecnn.score(alone, "x") > 0.99
    assert abs(bytecnn.score(bytecnn.learn(empty(spark), labels.limit(0), "quality"), "x") - 0.5) < 1e-6


def test_what_no_language_explains_goes(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = read_table(spark, DATA, "documents")
    model = langid.learn(docs)
    odd = ["Привет мир это русский текст о погоде", "これは日本語の文章です。天気がいいですね", "Η γρήγορη καφέ αλεπού πηδάει", letters(300), " ".join(letters(rng.randint(2, 9)) for _ in range(60))]
    rows = [row(i, text) for i, text in enumerate([*odd, None, "", "12 !!"])]
    clean = [row(100 + r.doc_id, r.text) for r in docs.limit(50).collect()]
    left = langid.told(spark.createDataFrame([*rows, *clean, clean[0]], SCHEMA), model, 0.3)
    assert left.columns == SCHEMA.names and Counter(r.doc_id for r in left.collect()) == Counter([*(r[0] for r in clean), clean[0][0]])
    assert left.filter("doc_id = 100").first().asDict() == dict(zip(SCHEMA.names, next(r for r in clean if r[0] == 100)))
    nothing = langid.learn(docs.limit(0))
    assert langid.told(docs, nothing).count() == 0 and langid.told(empty(spark), model).count() == 0
