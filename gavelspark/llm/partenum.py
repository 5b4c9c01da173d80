"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets that are similar enough differ
in a bounded number k of shingles, which depends on their sizes. So sets are put into bands of
size, and the domain of shingles (hashes) is cut into partitions, whose number depends on the band.
Of more than k partitions two similar sets agree in one at least. The partitions come in pairs
of which one mismatch is allowed, so the subsets to enumerate are the single partitions:
the content of a partition is a signature. Empty partitions say nothing; in a fixed order
of the others the first k + 1 are enough, and the first k + 1 + t hold t + 1 on which both agree. A
document with fewer than t + 1 signatures in common with others has no link, and each may
forget its t most common ones: the rarest of the t + 1 is then still there on both sides.

Sharing signatures is necessary, not sufficient: documents that share any, directly or through
others, form a candidate class. Chance ties ever more documents together as the corpus grows, so
classes of more than a block are cut once more, by whole sets: a similar set has ``percent`` of a set's
shingles at least, so a document without that many in common with its class has no link, and each may
forget its most common ones, all but the last of so many. Sets are compared within what is left, in
pairs of blocks of bounded size, and all links are found; what leaves a task is a spanning forest of them.

Equal sets are represented by one of their documents. A signature of very many documents
passes a task as a sorted stream. Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.components import components
from gavelspark.llm.rows import id_and_text, let_go, slices, small_or_not
from gavelspark.operators.scan import running_before
from gavelspark.session import shared_folder

WORDS = 5
# Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 75
# A set of n shingles gives n // SPARE signatures more than needed, to tell chance from likeness;
# where a partition holds one shingle, n // SINGLE_SPARE.
SPARE, SINGLE_SPARE = 16, 4
# Sizes from which partitions hold several shingles, and shingles of the largest set of a band in each.
_SINGLE, _FILL = 64, 2.0
# Shingles of a block of documents that are compared with another block at a time.
BLOCK_SHINGLES = 1 << 18

_PIECE = 1 << 20
_U = np.uint64


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_POWERS = _powers(0x9E3779B97F4A7C15, 1 << 16)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and a hash of each. Words are what white space separates; A-Z count as small letters."""
    raw = raw.lower()
    begins, hashes, at = [], [], 0
    whole = np.frombuffer(raw, dtype=np.uint8)
    while at < len(raw):
        stop = min(at + _PIECE, len(raw))
        if stop < len(raw):
            # a piece ends where a word does
            white = _WHITE[whole[at:stop]]
            last = np.flatnonzero(white)
            while not len(last) and stop < len(raw):
                further = min(stop + _PIECE, len(raw))
                last = np.flatnonzero(_WHITE[whole[stop:further]]) + (stop - at)
                stop = further
            if len(last) and stop < len(raw):
                stop = at + int(last[-1]) + 1
        part = whole[at:stop]
        inside = np.flatnonzero(~_WHITE[part])
        if len(inside):
            first = np.r_[True, np.diff(inside) > 1]
            starts = np.flatnonzero(first)
            place = np.arange(len(inside)) - np.repeat(starts, np.diff(np.r_[starts, len(inside)]))
            weight = _BYTE_POWERS[place & 0xFFFF] + (place >> 16).astype(np.uint64) * _U(0x2545F4914F6CDD1D)
            hashes.append(_mix(np.add.reduceat((part[inside].astype(np.uint64) + _U(1)) * weight, starts)))
            begins.append(inside[starts] + at)
        at = stop
    if not begins:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(raws: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; fewer words than a shingle are one."""
    joined = b"\n".join(raws)
    ends = np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1)
    begins, hashes = word_hashes(joined)
    cuts = np.r_[0, np.searchsorted(begins, ends)].tolist()
    factors = _powers(0xD1342543DE82EF95, words + 1)[1:]
    out = []
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for i in range(words):
        rolled += hashes[i : i + len(rolled)] * factors[i]
    rolled = _mix(rolled)
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(_mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _most(size: int, percent: int) -> int:
    """The largest set that can be similar to one of ``size``."""
    return size * 100 // percent


def differences(first: int, second: int, percent: int) -> int:
    """How many shingles two similar sets of these sizes can have that are in one of them only."""
    return (100 - percent) * (first + second) // (100 + percent)


def _single(tag: int) -> bool:
    return 2 << tag <= _SINGLE


def spare(size: int, tag: int) -> int:
    return size // (SINGLE_SPARE if _single(tag) else SPARE)


def _fallback(band: int) -> np.uint64:
    """The signature of sets with too few partitions that are not empty."""
    return _mix(np.array([0xE0000000 + band], dtype=np.uint64))[0]


FALLBACKS = [int(_fallback(band).astype(np.int64)) for band in range(48)]


def signatures(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, given as sorted hashes: of its own band, and of the next if similar sets reach it."""
    size = len(found)
    if not size:
        return np.empty(0, dtype=np.uint64)
    band = size.bit_length() - 1
    mixed = _mix(found)
    out = []
    for tag in (band, band + 1):
        largest = _most(size, percent)
        if tag > band and largest < 1 << tag:
            continue
        wanted = differences(size, min(largest, (2 << tag) - 1), percent) + 1 + spare(size, tag)
        highest = 2 << tag
        salt = _mix(np.array([tag + 1], dtype=np.uint64))
        if _single(tag):
            out.append(_mix(mixed[:wanted] + salt))
            if size < wanted:
                out.append(np.array([_fallback(tag)]))
            continue
        partitions = _U(int(highest / _FILL) + 1)
        # hashes are in order, so are their partitions
        part = (found >> _U(32)) * partitions >> _U(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        content = np.add.reduceat(mixed, starts)[:wanted]
        out.append(_mix(content + part[starts[:wanted]] * _U(0x9FB21C651E98DF25) + salt))
        if len(starts) < wanted:
            out.append(np.array([_fallback(tag)]))
    return np.concatenate(out)


def _identity(found: np.ndarray, doc: int) -> tuple[int, int]:
    """Two numbers that equal sets share: a hash, and another half hash with the size. An empty set has its own."""
    size = np.array([len(found)], dtype=np.uint64) if len(found) else np.array([doc], dtype=np.int64).view(np.uint64)
    first = _mix(_mix(found + _U(1)).sum(keepdims=True) + _mix(size + _U(3))).view(np.int64)[0]
    second = _mix(_mix(found + _U(2)).sum(keepdims=True) + _mix(size + _U(4)))[0]
    return int(first), ((int(second) | 1) & 0xFFFFFFFF) << 32 | len(found)


def _signed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """A row for each signature of each document, with ``extra`` 0, and one for its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            docs = batch.column("doc").to_numpy()
            raws = [(text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            sets = shingle_sets(raws, words)
            signs = [signatures(found, percent) for found in sets]
            whole = [_identity(found, int(doc)) for found, doc in zip(sets, docs)]
            counts = np.fromiter(map(len, signs), dtype=np.int64, count=len(signs))
            sig = np.concatenate([np.concatenate(signs).view(np.int64), np.array([a for a, _ in whole], dtype=np.int64)])
            extra = np.concatenate([np.zeros(int(counts.sum()), dtype=np.int64), np.array([b for _, b in whole], dtype=np.uint64).view(np.int64)])
            doc = np.concatenate([np.repeat(docs, counts), docs])
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(extra), pa.array(doc)], names=["sig", "extra", "doc"])

    return rows.mapInArrow(run, "sig long, extra long, doc long")


def _shared(signed: DataFrame) -> DataFrame:
    """The rows whose signature another row has too, and those of whole sets; ``first`` is the smallest document of the equal ones (0 for signatures)."""
    ordered = signed.repartition("sig").sortWithinPartitions("sig", "extra", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of the rows so far: key, document, first document of its run, whether it waits for a second one
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, extra, doc = (batch.column(name).to_numpy() for name in ("sig", "extra", "doc"))
            goes_on = last is not None and last[0] == sig[0] and last[1] == extra[0]
            if goes_on and last[4]:
                sig, extra, doc = (np.r_[x, y] for x, y in zip(last[:3], (sig, extra, doc)))
            new = np.r_[not (goes_on and not last[4]), (sig[1:] != sig[:-1]) | (extra[1:] != extra[:-1])]
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            firsts = doc[starts]
            if not new[0]:
                firsts, run_of = np.r_[last[3], firsts], run_of + 1
            sizes = np.bincount(run_of)
            several = sizes > 1
            if not new[0]:
                several[0] = True
            keep = several[run_of] | (extra != 0)
            waits = not several[-1] and extra[-1] == 0
            last = (sig[-1:], extra[-1:], doc[-1:], firsts[run_of[-1]], waits)
            last = (last[0][0], last[1][0], last[2][0], last[3], last[4])
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[keep]), pa.array(extra[keep]), pa.array(doc[keep]), pa.array(np.where(extra != 0, firsts[run_of], 0)[keep])], names=["sig", "extra", "doc", "first"]
                )

    return ordered.mapInArrow(run, "sig long, extra long, doc long, first long")


def _chained(shared: DataFrame) -> DataFrame:
    """Each document with the one before it among those of a signature: all of these are connected then."""
    ordered = shared.select("sig", "doc").repartition("sig").sortWithinPartitions("sig", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        for batch in batches:
            sig, doc = (np.r_[x, batch.column(name).to_numpy()] for x, name in zip(last, ("sig", "doc")))
            pair = (sig[1:] == sig[:-1]) & (doc[1:] != doc[:-1])
            both = np.unique(np.c_[doc[:-1][pair], doc[1:][pair]], axis=0)
            last = sig[-1:], doc[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _rarest(signed: DataFrame, spares: DataFrame) -> DataFrame:
    """The rows of ``sig`` and ``doc`` without signatures of one document and the ``spare`` most common ones of each; ``spares`` is stored."""
    # distinct rows and their counts in one exchange
    size = F.count("*").over(Window.partitionBy("sig")).alias("size")
    several = signed.repartition("sig").distinct().select("sig", "doc", size).filter("size > 1")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size"), "sig"))
    ranked = several.join(small_or_not(spares), "doc").withColumn("rank", rank)
    return ranked.filter("rank > spare").select("sig", "doc")


def _nodes(found: DataFrame) -> DataFrame:
    """``doc`` and ``component`` of all nodes of components, the smallest too."""
    roots = found.select(F.col("component").alias("doc"), "component").distinct()
    return found.select(F.col("node").alias("doc"), "component").union(roots)


def _sets(rows: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """The sets of the documents in ``placed`` (``doc``, ``component``, ``large``) as ``found``, sorted hashes."""
    texts = rows.join(small_or_not(placed), "doc").select("doc", "component", "large", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raws = [(text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            sets = [found.tobytes() for found in shingle_sets(raws, words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], names=["doc", "component", "large", "found"])

    return texts.mapInArrow(run, "doc long, component long, large boolean, found binary")


def _shingles(sets: DataFrame) -> DataFrame:
    """A row for each shingle of each set; ``sig`` is one of the shingle in its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "found", 1 << 20):
            found = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("found").to_pylist()]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            classes_of, docs = (batch.column(name).to_numpy() for name in ("component", "doc"))
            sig = _mix(np.concatenate(found) + np.repeat(_mix(classes_of.astype(np.uint64) + _U(1)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.repeat(docs, counts))], names=["sig", "doc"])

    return sets.select("doc", "component", "found").mapInArrow(run, "sig long, doc long")


def _closer(sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Candidate classes among sets of large ones: of documents that share one of their rarest shingles in the class."""
    spare = F.ceil(F.octet_length("found") / 8 * percent / 100) - 1
    sets.filter("octet_length(found) > 0").groupBy("doc").agg(F.min(spare).alias("spare")).write.parquet(f"{folder}/spares")
    return components(_chained(_rarest(_shingles(sets), sets.sparkSession.read.parquet(f"{folder}/spares"))))


def _links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, as pairs of places; between the two sides, or within one if there is one."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    ids, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    # a set of which too few shingles are in any other has no link
    linkable = 100 * np.bincount(owner, minlength=len(sets)) >= percent * sizes
    fine = linkable[owner]
    owner, number = owner[fine], number[fine]
    by_shingle = np.lexsort((owner, number))
    postings, ends = owner[by_shingle], np.cumsum(np.bincount(number, minlength=len(ids)))
    begins = ends - np.diff(np.r_[0, ends])
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    two = sides.min() != sides.max()
    out = []
    for a in np.flatnonzero(linkable).tolist():
        if two and sides[a] != sides[0]:
            continue
        own = number[cuts[a] : cuts[a + 1]]
        if not len(own):
            continue
        common = np.bincount(np.concatenate([postings[begins[i] : ends[i]] for i in own.tolist()]), minlength=len(sets))
        common[: a + 1] *= 0 if not two else 1
        alike = (100 * common >= percent * (sizes[a] + sizes - common)) & (common > 0)
        if two:
            alike &= sides != sides[a]
        for b in np.flatnonzero(alike).tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _verified(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between documents of one class; ``members`` has ``doc``, ``component``, ``block``, ``blocks``."""
    sets = sets.select("doc", "found").join(small_or_not(members), "doc")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("doc", "component", "block", "found", other)
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")

    def compare(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_numpy()
        order = np.argsort(docs, kind="stable")
        found = table.column("found").to_pylist()
        links = _links([np.frombuffer(found[i], dtype=np.uint64) for i in order.tolist()], table.column("block").to_numpy()[order], percent)
        ends = docs[order][np.array(links, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return pairs.select("doc", "component", "block", "found", low, high).groupBy("component", "low", "high").applyInArrow(compare, "a long, b long")


def classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id that links reach) of every document.

    Null and empty texts, and those of white space, have no shingle and no link. Rows without an
    id return a row each, with the size of their set and neither a link nor a component. Rows that
    repeat an id return a row each, and count as one node with the links of all of them. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "partenum")
    every = id_and_text(docs, id_column, text_column).select(F.col("doc_id").alias("doc"), "text")
    rows, nameless = every.filter("doc is not null"), every.filter("doc is null")
    _shared(_signed(rows, words, percent)).write.parquet(f"{folder}/shared")
    shared = spark.read.parquet(f"{folder}/shared")
    whole = shared.filter("extra <> 0").select("doc", F.col("first").alias("rep"), F.expr("extra & 4294967295").alias("n"))

    let_go(spark)

    # a document goes on if it has enough signatures in common with others; of equal sets one
    # similar sets may be smaller; sets that larger ones of the next kind of bands are similar to spare less
    few = F.when(F.floor(F.col("n") * 100 / percent) < _SINGLE, SINGLE_SPARE).otherwise(SPARE)
    need = F.floor(F.floor(F.col("n") * percent / 100) / few) + 1
    reps = whole.filter("doc = rep and n > 0").groupBy("doc").agg(F.max("n").alias("n"), F.min(need).alias("need"))
    counts = shared.filter("extra = 0").groupBy("doc").agg(F.count("*").alias("signatures"), F.max(F.col("sig").isin(*FALLBACKS)).alias("short"))
    enough = counts.join(reps, "doc").filter("signatures >= need or short").select(
        "doc", "n", F.when(F.col("short"), 0).otherwise(F.col("need") - 1).alias("spare")
    )
    enough.write.parquet(f"{folder}/enough")
    enough = spark.read.parquet(f"{folder}/enough")
    common = shared.filter("extra = 0").select("sig", "doc").join(small_or_not(enough.select("doc")), "doc", "left_semi")
    candidates = components(_chained(_rarest(common, enough.select("doc", "spare"))))
    let_go(spark)

    placed = _nodes(candidates).join(enough.select("doc", "n"), "doc")
    large = placed.groupBy("component").agg((F.sum("n") > block_shingles).alias("large"))
    placed.join(large, "component").select("doc", "component", "n", "large").write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    _sets(rows, placed.select("doc", "component", "large"), words).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    let_go(spark)

    if not placed.filter("large").isEmpty():
        closer = _nodes(_closer(sets.filter("large"), percent, folder)).join(enough.select("doc", "n"), "doc")
        placed = placed.filter("not large").select("doc", "component", "n").union(closer.select("doc", "component", "n"))
        let_go(spark)
    before = running_before(placed.select("doc", "component", "n"), ["component"], [("doc", 1 << 20)], {"before": ("sum", "n")})
    blocked = before.withColumn("block", F.floor(F.coalesce("before", F.lit(0)) / block_shingles))
    blocks = blocked.groupBy("component").agg((F.max("block") + 1).alias("blocks"))
    blocked.join(blocks, "component").select("doc", "component", "block", "blocks").write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")

    links = _verified(sets, members, percent)
    # an id with several different sets ties them together
    several = whole.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("doc", "low")
    tied = whole.join(several, "doc").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    found = components(links.union(tied))
    named = whole.join(found, whole["rep"] == found["node"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    return named.union(_sizes(nameless, words))


def _sizes(nameless: DataFrame, words: int) -> DataFrame:
    """The rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raws = [(text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, shingle_sets(raws, words)), pa.int64())], names=["n"])

    nothing = F.lit(None).cast("long")
    return nameless.select("text").mapInArrow(run, "n long").select(nothing.alias("doc_id"), F.col("n").alias("n_shingles"), nothing.alias("component_id"))
