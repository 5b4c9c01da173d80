"""Every registered corpus query against its SQL, revisits, and the pipeline."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from functools import partial
from hashlib import sha256

import pytest
from conftest import SMALL
from corpus_cases import SCHEMA, TEXTS, awkward, empty, prose, row
from oracle import compare, connect

import __spark_entry__ as driver
import corpus_pipeline
from gavelspark.llm import partenum, revisits
from gavelspark.llm.plans import PLANS, SQL


@pytest.fixture(scope="module")
def con():
    connection = connect(SMALL)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    _, _, problem = compare(spark, con, PLANS[name], SQL[name], SMALL)
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert PLANS[name](spark, SMALL).count() == docs


def test_all_are_registered():
    names = driver.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names


# revisits

RECORDS = "record_id long, url string, at timestamp, status int, head string, latest string, own string"


def record(i, url, second, status, head=""):
    return (i, url, None if second is None else datetime(2024, 1, 1, 0, 0, second), status, head, "x", "y")


def test_revisits(spark):
    full = "HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\nDate: 1\r\nX: 1\r\nx: 2"
    rows = [
        record(1, "http://www.Site.org/a/?b=2&a=1&utm_x=3#top", 1, 200, full),
        record(2, "https://site.org:443/a?a=1&b=2", 2, 304, "HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nDate: 2\r\nContent-Type: text/plain\r\nConnection: close"),
        record(3, "http://site.org/a?a=1&b=2", 3, 304, "HTTP/1.1 304\r\nETag: \"b\""),
        record(4, "http://site.org/a?a=1&b=2", 0, 304, ""),
        record(5, "http://other.org", 5, 200, "HTTP/1.1 200 OK\r\nLast-Modified: x"),
        record(6, "http://other.org/", 6, 304, "HTTP/1.1 304\nLast-Modified: x"),
        record(7, "http://other.org/", 7, 304, "HTTP/1.1 304\r\nLast-Modified: y"),
        record(8, "http://other.org/", 8, 304, None), record(9, None, 9, 304), record(10, "not a url", 9, 200, full),
        record(11, "http://other.org/", None, 304), record(12, "http://other.org/", 9, 404), record(None, "http://other.org/", 9, 304),
        record(13, "http://other.org/", 5, 200, "HTTP/1.1 200 OK\r\nLast-Modified: z"), record(14, "http://other.org/", 5, 304, ""),
        record(5, "http://other.org", 5, 200, "HTTP/1.1 200 OK\r\nLast-Modified: x"),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(got) == len(rows)
    by_id = {r.record_id: r for r in got}
    assert by_id[1].outcome == "full" and by_id[1].headers["x"] == "1, 2" and by_id[1].url == "site.org/a?a=1&b=2"
    assert by_id[2].outcome == "resolved" and by_id[2].refers_to == 1
    assert by_id[2].headers == {"etag": 'W/"a"', "content-type": "text/html", "date": "2", "x": "1, 2"}
    assert (by_id[3].outcome, by_id[3].refers_to) == ("changed", None)
    assert by_id[4].outcome == "missing" and by_id[9].outcome == by_id[11].outcome == by_id[None].outcome == "missing"
    # the latest response of the other site is 13: last changed at z
    assert [by_id[i].outcome for i in (6, 7, 8)] == ["changed", "changed", "resolved"] and by_id[8].refers_to == 13
    assert by_id[12].outcome == "other" and by_id[14].refers_to == 13
    assert revisits.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_a_hot_url_is_cut_into_chunks(spark, monkeypatch):
    rows = [record(i, "http://hot.org/", i % 60, 200 if i % 7 == 0 else 304) for i in range(300)]
    df = spark.createDataFrame(rows, RECORDS)
    plain = Counter((r.record_id, r.outcome, r.refers_to) for r in revisits.resolve(df).collect())
    from gavelspark.operators import scan

    cut = lambda *args: scan.running_before(*args, hot_rows=50)
    monkeypatch.setattr(revisits, "running_before", cut)
    assert Counter((r.record_id, r.outcome, r.refers_to) for r in revisits.resolve(df, "10 seconds").collect()) == plain
    order = sorted(range(300), key=lambda i: (i % 60, i))
    last, wanted = None, {}
    for i in order:
        wanted[i] = None if i % 7 == 0 else last
        last = i if i % 7 == 0 else last
    assert {i: to for i, _, to in plain} == wanted


# benchmark items

def test_items_without_an_id_contaminate(spark, folder):
    passage = " ".join(prose(1, 41, 30, 30))
    docs = [row(1, "before " + passage + " after"), row(2, "a clean text of its own")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, passage), (7, "after")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in PLANS["op3_benchmark_suffixes"](spark, folder).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (31, 2, True) and got[1].items_sha256 == sha256(b"7").hexdigest()
    assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (0, 0, False)
    unnamed = f"{folder}/unnamed"
    spark.createDataFrame([(None, passage)], "item_id long, text string").write.parquet(f"{unnamed}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, spark.createDataFrame(docs, SCHEMA), unnamed).collect()] == [2]


# pipeline

def test_pipeline_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "decontamination", "token_ids"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, SMALL)
        if name != "token_ids":
            assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
            docs = left
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.99 * counts[0] and counts[-1] == counts[-2]
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_documents(spark, stage):
    docs = awkward(spark)
    left = stage(spark, docs, SMALL)
    rows = left.collect()
    if stage is not corpus_pipeline.token_ids:
        assert left.columns == docs.columns
    kept = {r.doc_id for r in rows}
    if stage is corpus_pipeline.language:
        assert not kept & {4, 5, 6, 7}
    if stage is corpus_pipeline.near_duplicates:
        assert 1 in kept and not kept & {2, 3}
    assert 11 in kept and stage(spark, empty(spark), SMALL).count() == 0


def test_near_duplicates_of_documents_tied_by_chance(spark, monkeypatch):
    """Stock phrases tie all documents into one class of candidates; no set goes to more than one block of it."""
    phrases = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(80)]
    texts = {i: " ".join([phrases[i], *(f"d{i}w{j}" for j in range(10)), phrases[(i + 1) % 80]]) for i in range(80)}
    copies = {100 + i: texts[i] + " and more" for i in range(0, 80, 5)}
    seen, verified = [], partenum._verified
    monkeypatch.setattr(partenum, "_verified", lambda *args: seen.append(args[1]) or verified(*args))
    monkeypatch.setattr(partenum, "classes", partial(partenum.classes, block_shingles=500))
    docs = spark.createDataFrame([row(i, text) for i, text in (texts | copies).items()], SCHEMA).repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in kept) == sorted(texts)
    assert {r.blocks for r in seen[0].collect()} == {1}


def test_one_row_of_each_class_whatever_the_ids(spark):
    base = [" ".join(prose(1, seed, 60, 60)) for seed in (31, 32)]
    texts = prose(1, 33, 60, 60)
    rows = [row(None, base[0]), row(None, base[0] + " x"), row(5, base[1]), row(5, base[1]), row(None, base[1] + " x"), row(9, base[1] + " y"), row(9, texts[0])]
    docs = spark.createDataFrame(rows + [row(None, None), row(None, "")], SCHEMA).repartition(3)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    one = [x for x in left if x[0] is None and x[1] and x[1].startswith(base[0])]
    assert len(one) == 1 and left == Counter([one[0], (5, base[1]), (9, texts[0]), (None, None), (None, "")])
    again = corpus_pipeline.near_duplicates(spark, awkward(spark), SMALL).collect()
    assert Counter(r.doc_id for r in again)[1] == 1 and TEXTS[1] not in {r.text for r in again if r.doc_id is None}
    assert {r.text for r in again if r.doc_id == 8} == {"one", "another text of the same id"}


def test_lines_that_recur_go_once(spark):
    lines = [f"{text}\nShared line of every page 12{i}" for i, text in enumerate(prose(40, 17))]
    docs = spark.createDataFrame([row(i, text) for i, text in enumerate(lines)] + [row(99, "Shared line of every page 7")], SCHEMA)
    left = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert left[0].text == lines[0] and 99 not in left
    assert all(left[i].text == lines[i].split("\n")[0] and left[i].n_chars == len(left[i].text) for i in range(1, 40))
