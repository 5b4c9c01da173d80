"""Exact top-k search by MaxScore over integer vectors.

A component x of a vector is the integer floor(scale * x). A term is a dimension and a sign:
its postings are the vectors with a component of that sign, with that weight. A query gains
from the terms where its own component has the same sign and loses on those of the other
sign. For each shard of vectors the largest weight of a term bounds what it can add. Once k
scores are known, the terms of the smallest bounds that together cannot reach the k-th score are
non-essential: a vector in no other posting cannot enter the result. The postings of the essential
terms are traversed; their vectors are the candidates, which are probed in the other terms, the largest
bound first, and stay as long as what is still to come can lift them to the k-th score. Where the
essential postings are so long that nearly every vector is in one (dense vectors), or the k-th
score is not above zero, all vectors of the shard begin as candidates and bounds alone prune.
The best of all shards are merged.

Vectors are stored with a number, dealt into shards by it, and sent to their shard ahead of the
queries, which stream past them. One pass serves all queries; neither vectors nor queries go
through the driver. A shard returns k rows a query, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.session import shared_folder

# Vectors in a shard at most, and those for which a further shard is opened while cores are idle.
SHARD_ROWS, LEAST_ROWS = 65_536, 2048
# Queries that are searched at a time.
_QUERIES_AT_ONCE = 512
# Essential postings that are so many times as long as the shard leave out next to nothing.
DENSE = 2
# Scores are added up in doubles, which are exact up to here; larger ones take Python's integers.
_EXACT = float(1 << 53)


def matrix_of(vectors: list[list[float]], scale: int) -> np.ndarray:
    """Rows of integers; a shorter vector has zeros at its end."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    return np.floor(out * scale)


class Shard:
    """Some vectors by term: for each dimension and sign the postings and the largest weight.

    ``begun`` and ``read`` count the candidates and the terms read of all searches so far.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(names, kind="stable")
        self.names, self.matrix = names[order], matrix[order]
        # one row of weights a dimension: what a term adds to the vectors of its postings
        self.weights = np.ascontiguousarray(self.matrix.T)
        self.highest = np.maximum(self.weights.max(axis=1), 0) if len(names) else np.zeros(matrix.shape[1])
        self.lowest = np.minimum(self.weights.min(axis=1), 0) if len(names) else np.zeros(matrix.shape[1])
        self.lengths = np.stack([np.count_nonzero(self.weights > 0, axis=1), np.count_nonzero(self.weights < 0, axis=1)], axis=1)
        self._postings: dict[tuple[int, bool], np.ndarray] = {}
        self.begun = self.read = 0

    def postings(self, dimension: int, negative: bool) -> np.ndarray:
        """The places of the vectors whose component has the sign, in order; listed when first asked for."""
        key = (int(dimension), bool(negative))
        if key not in self._postings:
            row = self.weights[key[0]]
            self._postings[key] = np.flatnonzero(row < 0 if negative else row > 0).astype(np.int32)
        return self._postings[key]

    def _essential(self, terms: np.ndarray, negative: np.ndarray, others: np.ndarray, name: int) -> np.ndarray:
        """The vectors in a posting of the essential terms, in order; all ``others`` if these leave out next to nothing."""
        if self.lengths[terms, negative.astype(np.intp)].sum() >= DENSE * len(self.names):
            return others
        held = np.zeros(len(self.names), dtype=bool)
        for term, sign in zip(terms, negative):
            held[self.postings(term, sign)] = True
        live = np.flatnonzero(held)
        return live[self.names[live] != name]

    def best(self, name: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and scores of the k best vectors, ties to the smaller name; not those of the query's own name."""
        width = min(len(query), len(self.weights))
        query, weights = query[:width], self.weights[:width]
        bound = np.where(query > 0, query * self.highest[:width], query * self.lowest[:width])
        if len(self.names) == 0:
            return self.names, np.empty(0)
        if np.abs(query) @ np.maximum(self.highest, -self.lowest)[:width] >= _EXACT:
            rows = [sum(int(a) * int(b) for a, b in zip(query, row)) for row in self.matrix[:, :width]]
            live = [i for i in range(len(rows)) if self.names[i] != name]
            live = sorted(live, key=lambda i: (-rows[i], self.names[i]))[:k]
            return self.names[live], np.array([rows[i] for i in live], dtype=object)
        terms = np.argsort(-bound, kind="stable")
        terms = terms[query[terms] != 0]
        # what the terms from each place on can still add
        rest = np.r_[np.cumsum(bound[terms][::-1])[::-1], 0.0]
        others = np.flatnonzero(self.names != name)
        # scores of some vectors give a k-th score to begin with: of the strongest term, if it has enough
        most = max(4 * k, 64)
        first = self.postings(terms[0], query[terms[0]] < 0)[: most + 1] if len(terms) else others[:0]
        first = first[self.names[first] != name]
        first = first if len(first) >= k else others[:most]
        known = np.sort(weights[:, first].T @ query)
        least = known[-k] if len(known) >= k else -np.inf
        # the terms after the essential ones cannot reach the k-th score together
        essential = int(np.count_nonzero(rest[:-1] >= least))
        live = self._essential(terms[:essential], query[terms[:essential]] < 0, others, name) if least > 0 else others
        essential = max(1, min(essential, len(terms)))
        self.begun += len(live)
        scores, at = np.zeros(len(live)), 0
        while at < len(terms) and len(live):
            step = terms[at : at + max(8, essential // 2)]
            at += len(step)
            block = weights[step] if len(live) == len(self.names) else weights[np.ix_(step, live)]
            scores = scores + query[step] @ block
            keep = scores + rest[at] >= least
            if at < len(terms) and not keep.all():
                live, scores = live[keep], scores[keep]
            if len(scores) > k:
                # what the terms to come can take away at most
                below = np.minimum(query[terms[at:]] * self.highest[terms[at:]], query[terms[at:]] * self.lowest[terms[at:]]).sum()
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k] + below)
        self.read += at
        top = np.lexsort((self.names[live], -scores))[:k]
        return self.names[live[top]], scores[top]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _search(dealt: DataFrame, scale: int, k: int) -> DataFrame:
    """The k best of each shard for each query; rows come by shard, its vectors before the queries (``asks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, shard = None, [], None
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            turn = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            cuts = np.unique(np.r_[0, turn, np.arange(0, len(numbers), _QUERIES_AT_ONCE), len(numbers)]).tolist()
            for start, stop in zip(cuts, cuts[1:]):
                if numbers[start] != number:
                    number, parts, shard = numbers[start], [], None
                names = batch.column("name").slice(start, stop - start).to_numpy()
                matrix = matrix_of(batch.column("vector").slice(start, stop - start).to_pylist(), scale)
                if not asks[start]:
                    parts.append((names, matrix))
                    continue
                if shard is None and parts:
                    shard, parts = _shard_of(parts), []
                if shard is not None:
                    yield _found(names, [shard.best(name, query, k) for name, query in zip(names.tolist(), matrix)])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _shard_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Shard:
    """One shard of all parts; narrower ones are filled up with zeros."""
    width = max(matrix.shape[1] for _, matrix in parts)
    wide = [np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) for _, matrix in parts]
    return Shard(np.concatenate([names for names, _ in parts]), np.concatenate(wide))


def _found(names: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(names, [len(found) for found, _ in best]), pa.int64()),
            pa.array(np.concatenate([found for found, _ in best]), pa.int64()),
            pa.array([int(x) for _, scores in best for x in scores], pa.int64()),
        ],
        names=["query_id", "vec_id", "score"],
    )


def top_k(
    vectors: DataFrame, is_query: Column, scale: int = 1024, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best vectors of every query.

    Queries are the rows where ``is_query`` holds, candidates all rows but those of the
    query's own id. Vectors that are null or hold a null or a number that is not finite take no
    part, nor do rows without an id. Ties go to the smaller id; a shorter vector counts as
    filled up with zeros. A score has to fit in 64 bits. A query id that is repeated is
    searched once, by the first of its vectors in order. Other columns are ignored.
    """
    spark = vectors.sparkSession
    taking_part = vectors.filter(vectors[id_column].isNotNull() & usable(vectors[vector_column]))
    name, vector = vectors[id_column].cast("long").alias("name"), vectors[vector_column].cast("array<double>").alias("vector")
    folder = shared_folder(spark, "maxscore")
    numbered = taking_part.select(name, vector, F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("place"))
    numbered.write.parquet(f"{folder}/rows")
    rows = spark.read.schema("name long, vector array<double>, asks boolean, place long").parquet(f"{folder}/rows")
    total = rows.count()
    shards = max(1, -(-total // shard_rows), min(spark.sparkContext.defaultParallelism, total // LEAST_ROWS))
    # vectors go by their number, so equal ids and copies are spread; every shard gets all queries
    candidates = rows.select(F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "name", "vector")
    asked = rows.filter("asks").groupBy("name").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "name", "vector")
    dealt = candidates.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _search(dealt, scale, k).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
