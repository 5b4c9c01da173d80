"""Ranked search with a frequent-pattern tree over documents.

A document's vector is restricted to the terms of the queries and ordered by how many documents hold
a term, most frequent first. In a shard the ordered vectors share the paths of a trie. A node knows the
largest tf of every term and the smallest m below it, so the score of a query at these values is a
bound on all documents of the subtree. The trie is walked depth first, the most promising child
first, for all queries that are still open at a node; a query leaves where the bound is under its
tenth score so far. At the ends, the few documents of a node are scored exactly, for the queries left.

Vectors are written once. Each task reads its own in shards of bounded size, carries every query's best
rows from shard to shard, and returns them; the best of all tasks are ranked by a window per query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappush, heapreplace
from itertools import chain, repeat
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gavelspark.llm.decontam import words_of
from gavelspark.llm.rows import id_and_text, slices, texts_of
from gavelspark.session import shared_folder

TOP = 10
# Bytes of query text in one pass over the documents.
BLOCK_BYTES = 16 << 20
# Terms of the queries that share a tree, if one query has no more.
GROUP_TERMS = 2048
# Documents, or numbers of a dense table of them by term, in a shard.
SHARD_DOCS = 8192
SHARD_CELLS = 1 << 24
# Nodes of so many documents or fewer are ends.
END_DOCS = 16

_SCALE = np.int64(1_000_000_000)
_ROOT = (0, 0)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, before its weight: grows with tf, falls with m."""
    return _SCALE * tf // (1000 * tf + 8 * m)


def weight(holders: int, n_docs: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * holders + 1)))


class Group:
    """Queries that share a tree: their terms in order of frequency, and each query's terms and weights."""

    def __init__(self, queries: Sequence[tuple[int, list[int]]], holders: dict[int, int], n_docs: int) -> None:
        terms = sorted({term for _, own in queries for term in own}, key=lambda term: (-holders[term], term))
        place = {term: i for i, term in enumerate(terms)}
        self.terms = np.array(terms, dtype=np.int64)
        self.numbers = [number for number, _ in queries]
        self.sizes = np.array([len(own) for _, own in queries], dtype=np.int64)
        self.columns = np.array([place[term] for _, own in queries for term in own], dtype=np.int64)
        self.weights = np.array([weight(holders[term], n_docs) for _, own in queries for term in own], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scores(self, parts: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Scores of the open queries (columns) for each row of contributions by term."""
        if len(open_) == len(self.numbers):
            picked, starts = slice(None), self.starts
        else:
            sizes = self.sizes[open_]
            starts = np.cumsum(sizes) - sizes
            picked = np.arange(sizes.sum()) + np.repeat(self.starts[open_] - starts, sizes)
        return np.add.reduceat(parts[:, self.columns[picked]] * self.weights[picked], starts, axis=1)


class Node:
    """A subtree: the documents from ``low`` to ``high``, largest tf by term, smallest m, and children (none at an end)."""

    __slots__ = ("low", "high", "most", "least_m", "children")

    def __init__(self, low: int, high: int, most: np.ndarray, least_m: int, children: list[Node]) -> None:
        self.low, self.high, self.most, self.least_m, self.children = low, high, most, least_m, children


class Tree:
    """The trie of a shard. Rows are (document, term's place, tf) in arrays, documents from 0 on; ``m`` by document."""

    def __init__(self, doc: np.ndarray, column: np.ndarray, tf: np.ndarray, m: np.ndarray, width: int, end_docs: int = END_DOCS) -> None:
        order = np.lexsort((column, doc))
        doc, column, tf = doc[order], column[order], tf[order]
        cuts = np.searchsorted(doc, np.arange(len(m) + 1))
        wide = column.astype(">u4").tobytes()
        paths = [wide[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        self.order = np.array(sorted(range(len(m)), key=paths.__getitem__), dtype=np.int64)
        self._paths = [paths[i] for i in self.order.tolist()]
        self._lengths = [len(path) // 4 for path in self._paths]
        self._cuts, self._column, self._tf = cuts, column, tf
        self.m, self.width, self.end_docs = m[self.order], width, end_docs
        self.root = self._node(0, len(m), 0)

    def rows(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (counted from ``low``), term's place and tf of some documents in the order of the trie."""
        own = self.order[low:high]
        sizes = self._cuts[own + 1] - self._cuts[own]
        at = np.arange(sizes.sum()) + np.repeat(self._cuts[own] - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(high - low), sizes), self._column[at], self._tf[at]

    def table(self, low: int, high: int) -> np.ndarray:
        """tf of documents (rows) by term."""
        out = np.zeros((high - low, self.width), dtype=np.int64)
        doc, column, tf = self.rows(low, high)
        out[doc, column] = tf
        return out

    def _node(self, low: int, high: int, depth: int) -> Node:
        while True:
            if high - low <= self.end_docs:
                return Node(low, high, self.table(low, high).max(axis=0), int(self.m[low:high].min()), [])
            # a path without a branch is one node
            shared = self._paths[low][: 4 * depth + 4]
            if len(shared) == 4 * depth + 4 and self._paths[high - 1].startswith(shared):
                depth += 1
            else:
                break
        children, at = [], low
        while at < high and self._lengths[at] == depth:
            # documents that end here are alike in all terms; they come in ends of bounded size
            stop = at + 1
            while stop < high and stop - at < self.end_docs and self._lengths[stop] == depth:
                stop += 1
            children.append(self._node(at, stop, depth))
            at = stop
        while at < high:
            branch, stop, beyond = self._paths[at][: 4 * depth + 4], at + 1, high
            while stop < beyond:  # the first document that leaves the branch
                middle = (stop + beyond) // 2
                stop, beyond = (middle + 1, beyond) if self._paths[middle].startswith(branch) else (stop, middle)
            children.append(self._node(at, stop, depth + 1))
            at = stop
        return Node(low, high, np.maximum.reduce([child.most for child in children]), min(child.least_m for child in children), children)


class Best:
    """The best documents of each query so far: by score, then the smaller id; documents without an id come last."""

    def __init__(self, n_queries: int, k: int = TOP) -> None:
        self.k, self.rows = k, [[] for _ in range(n_queries)]
        # a document has to reach this score
        self.least = np.ones(n_queries, dtype=np.int64)
        self.scored = 0

    def offer(self, query: int, score: int, doc: int | None) -> None:
        held, entry = self.rows[query], (score, doc is not None, 0 if doc is None else -doc)
        if len(held) < self.k:
            heappush(held, entry)
        elif entry > held[0]:
            heapreplace(held, entry)
        if len(held) == self.k:
            self.least[query] = held[0][0]


def search(tree: Tree, group: Group, docs: Sequence[int | None], best: Best) -> None:
    """Depth-first branch and bound for all queries of a group; ``docs`` are the shard's ids."""
    names = [docs[i] for i in tree.order.tolist()]
    every = np.arange(len(group.numbers))
    bounds = group.scores(contribution(tree.root.most, np.int64(tree.root.least_m))[None, :], every)[0]
    stack = [(tree.root, every, bounds)]
    while stack:
        node, open_, bounds = stack.pop()
        # the scores to reach may have grown since the node was put aside; equal scores may still win by id
        still = bounds >= best.least[open_]
        open_ = open_[still]
        if not len(open_):
            continue
        if not node.children:
            scores = group.scores(contribution(tree.table(node.low, node.high), tree.m[node.low : node.high, None]), open_)
            best.scored += scores.size
            doc, query = np.nonzero(scores >= best.least[open_])
            for i, j in zip(doc.tolist(), query.tolist()):
                best.offer(int(open_[j]), int(scores[i, j]), names[node.low + i])
            continue
        most = np.stack([child.most for child in node.children])
        least_m = np.array([child.least_m for child in node.children], dtype=np.int64)
        below = group.scores(contribution(most, least_m[:, None]), open_)
        for i in np.argsort(below.sum(axis=1), kind="stable").tolist():  # the most promising child is on top
            stack.append((node.children[i], open_, below[i]))


class Vocabulary:
    """Query terms as numbers from 1 on."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.of: dict[bytes, int] = {}
        self.queries = [sorted({self.of.setdefault(word, len(self.of) + 1) for word in words_of(text)}) for text in texts]


def _vectors(rows: DataFrame, of: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and query terms with their tf, of every document that has a term."""
    shipped = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shipped.value
        wide = np.int64(len(of) + 1)
        for batch in slices(batches, "text"):
            split = [words_of(text) for text in texts_of(batch, "text")]
            counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            numbers = np.fromiter(map(of.get, chain.from_iterable(split), repeat(0)), dtype=np.int64, count=int(counts.sum()))
            pair, tf = np.unique((np.repeat(np.arange(len(split)), counts) * wide + numbers)[numbers > 0], return_counts=True)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(pair // wide, minlength=len(split)))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % wide, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def grouped(queries: Sequence[list[int]], most: int = GROUP_TERMS) -> list[list[tuple[int, list[int]]]]:
    """Queries in runs of at most ``most`` different terms, or of one query; those without a term are in none."""
    out: list[list[tuple[int, list[int]]]] = []
    held: set[int] = set()
    for number, terms in enumerate(queries):
        if not terms:
            continue
        if not out or len(held | set(terms)) > most:
            out.append([])
            held = set()
        out[-1].append((number, terms))
        held.update(terms)
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def best_of(shard: pa.Table, groups: Sequence[Group], n_docs: int, n_terms: int, best: Best, end_docs: int = END_DOCS) -> None:
    """Search one shard for all groups."""
    ids = shard.column("doc_id").to_pylist()
    m = np.array([10 + 90 * n * n_docs // n_terms for n in shard.column("n").to_pylist()], dtype=np.int64)
    terms, tfs = shard.column("terms").combine_chunks(), shard.column("tfs").combine_chunks()
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
    for group in groups:
        place = np.full(int(max(group.terms.max(), term.max(initial=0))) + 1, -1, dtype=np.int64)
        place[group.terms] = np.arange(len(group.terms))
        column = place[term]
        own = column >= 0
        # documents without a term of the group score nothing
        some, compact = np.unique(doc[own], return_inverse=True)
        if len(some):
            tree = Tree(compact, column[own], tf[own], m[some], len(group.terms), end_docs)
            sub = _GroupBest(best, group.numbers)
            search(tree, group, [ids[i] for i in some.tolist()], sub)
            sub.store()


class _GroupBest(Best):
    """The rows of some queries of ``whole``, under numbers from 0 on."""

    def __init__(self, whole: Best, numbers: Sequence[int]) -> None:
        self.whole, self.numbers, self.k = whole, numbers, whole.k
        self.rows, self.least, self.scored = [whole.rows[i] for i in numbers], whole.least[numbers], 0

    def store(self) -> None:
        self.whole.least[self.numbers] = self.least
        self.whole.scored += self.scored


def _candidates(vectors: DataFrame, groups: list[Group], n_queries: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of each task."""
    shipped = vectors.sparkSession.sparkContext.broadcast(groups)
    widest = max(len(group.terms) for group in groups)
    # ends and inner nodes of a shard together hold less than a dense table of its documents
    most = max(END_DOCS, min(SHARD_DOCS, SHARD_CELLS // widest * (END_DOCS // 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_queries, k)
        for shard in _shards(batches, most):
            best_of(shard, shipped.value, n_docs, n_terms, best)
        rows = [(query, -low if there else None, score) for query, held in enumerate(best.rows) for score, there, low in held]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"]
        )

    return vectors.mapInArrow(run, "query int, doc_id long, score long")


def rank(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
    k: int = TOP, block_bytes: int = BLOCK_BYTES, group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of every item that scores above zero with any.

    Texts that are null or without a term are no documents and no queries. Rows that repeat a document
    are ranked each; each row of ``items`` is a query of its own, also if it repeats an id. Equal scores
    go by ascending id, those without an id last. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "fp-tree")
    rows = id_and_text(docs, id_column, text_column)
    kind = items.schema[item_column].dataType
    asked = items.select(items[item_column].cast("string").alias("item"), items[item_text_column].alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = []
    for block in range(blocks):
        own = sorted(asked.filter(part == block).collect(), key=lambda row: (row["item"] or "", row["text"]))
        vocabulary = Vocabulary([row["text"] for row in own])
        path = f"{folder}/vectors{block}"
        _vectors(rows, vocabulary.of).write.parquet(path)
        vectors = spark.read.parquet(path)
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        # one row for each query term of the block
        holders = Counter({row[0]: row[1] for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()})
        groups = [Group(queries, holders, n_docs) for queries in grouped(vocabulary.queries, group_terms)]
        if not groups:
            continue
        best = _candidates(vectors, groups, len(own), n_docs, n_terms or 1, k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(own)], "query int, item string")
        found.append(ranked.join(F.broadcast(names), "query").select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item string, rank int, doc_id long, score long").select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")
    return reduce(DataFrame.unionByName, found)
