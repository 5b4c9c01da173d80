"""Near duplicates by fingerprints of few differing bits, found with covering bit masks.

A fingerprint has a bit for each of 64 majority votes over the hashes of a text's shingles. Every
bit belongs to one of ``2^(radius+1) - 1`` vectors over two elements; the mask of a table takes the
bits whose vector has an odd product with the table's own. Any ``radius`` vectors leave some table
with product zero on all of them, so two fingerprints that differ in at most ``radius`` bits agree
under that table's mask: no link is lost, whatever the data.

Equal fingerprints are one row from then on. Buckets of few fingerprints are compared pair by pair.
In a larger bucket nobody is compared: every fingerprint is sent to the points around it, within
half the radius over the bits that the mask leaves open; those that meet in a point are linked to
one of them. A point has few neighbours, so no group grows with the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gavelspark.llm.components import components
from gavelspark.llm.rows import id_and_text, slices, small_or_not
from gavelspark.session import shared_folder

BITS = 64
# Words of a shingle, and the seed of its hash.
WORDS = 3
SEED = 42
# Fingerprints link if at most so many bits differ.
RADIUS = 2
# Up to so many fingerprints of a bucket are compared with each other.
BUCKET = 64

# Votes are counted in fields of 16 bits, four to a number.
_FIELD = 16
_FIELDS = np.uint64(0x0001000100010001)
_MOST = (1 << _FIELD) - 1


def shingle_hashes(raw: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """Hashes of all shingles of a text; only A-Z become small, and words end at ASCII white space."""
    split = raw.lower().split()
    if len(split) <= words:
        return [xxh64_intdigest(b" ".join(split), seed)] if split else []
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1)
    starts = np.r_[0, ends[:-1]]
    cuts = map(slice, starts[: 1 - words].tolist() if words > 1 else starts.tolist(), (ends[words - 1 :] - 1).tolist())
    return list(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: the bits that are set in over half of them; zero for none."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    sizes = counts[some]
    # a field counts to 65535: longer runs are summed in parts
    parts = -(-sizes // _MOST)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.repeat(np.cumsum(sizes) - sizes, parts) + within * _MOST
    first_part = np.cumsum(parts) - parts
    found = np.zeros(len(some), dtype=np.uint64)
    for low in range(_FIELD):
        summed = np.add.reduceat((hashes >> np.uint64(low)) & _FIELDS, begins)
        for bit in range(low, BITS, _FIELD):
            votes = np.add.reduceat((summed >> np.uint64(bit - low) & np.uint64(_MOST)).astype(np.int64), first_part)
            found |= (2 * votes > sizes).astype(np.uint64) << np.uint64(bit)
    out[some] = found
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits as a long) of every row; texts that are null or without a word have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raws = ((text or "").encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist())
            found = [np.array(shingle_hashes(raw, words, seed), dtype=np.uint64) for raw in raws]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            prints = majority(np.concatenate(found), counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, fingerprint long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of which, for any ``radius`` bits, at least one takes none of them. Bits are dealt to the vectors in turn."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [1 + bit % vectors for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (of_bit[bit] & table).bit_count() % 2) for table in range(1, vectors + 1)]


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >= 1 << (BITS - 1) else number


def _steps(mask: int, most: int) -> list[tuple[int, int]]:
    """Every way to change up to ``most`` of the bits that a mask leaves open, with their number."""
    open_bits = [bit for bit in range(BITS) if not mask >> bit & 1]
    return [(_signed(sum(1 << bit for bit in chosen)), n) for n in range(most + 1) for chosen in combinations(open_bits, n)]


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a`` and ``b``: links whose components are those of all pairs that differ in at most ``radius`` (up to 3) bits.

    ``prints`` has the distinct fingerprints in ``fingerprint``. Every link is one of those pairs; of
    larger buckets there are fewer links than pairs.
    """
    if radius not in (1, 2, 3):
        raise ValueError("radius is 1, 2 or 3")
    spark = prints.sparkSession
    folder = shared_folder(spark, "covering")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, mask in enumerate(masks)])
    keyed = prints.select("fingerprint", F.explode(tables).alias("t")).select("fingerprint", "t.table", "t.key")
    keyed.groupBy("table", "key").agg(F.count("*").alias("size")).filter(F.col("size") > bucket).select("table", "key").write.parquet(f"{folder}/large")
    large = small_or_not(spark.read.parquet(f"{folder}/large"))

    few = keyed.join(large, ["table", "key"], "left_anti")
    x, y = few.select("table", "key", F.col("fingerprint").alias("a")), few.select("table", "key", F.col("fingerprint").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    compared = x.join(y, ["table", "key"]).filter((F.col("a") < F.col("b")) & (differ <= radius)).select("a", "b")

    # fingerprints within the radius have a point in common that is within the inner distance of one and the outer of the other
    inner, outer = radius // 2, -(-radius // 2)
    around = F.array(*[F.array(*[F.struct(F.lit(step).alias("step"), F.lit(n <= inner).alias("near")) for step, n in _steps(mask, outer)]) for mask in masks])
    many = keyed.join(large, ["table", "key"]).select("table", "key", "fingerprint", F.explode(F.get(around, F.col("table"))).alias("s"))
    points = many.select("table", F.col("fingerprint").bitwiseXOR(F.col("s.step")).alias("point"), "fingerprint", "s.near")
    met = points.groupBy("table", "point").agg(
        F.min(F.when(F.col("near"), F.col("fingerprint"))).alias("a"), F.collect_list("fingerprint").alias("others")
    ).filter((F.size("others") > 1) & F.col("a").isNotNull())
    joined = met.select("a", F.explode("others").alias("b")).filter("a <> b")
    return compared.unionByName(joined)


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED, radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` (the smallest id that links reach) of every row.

    Texts that are null, empty or of white space have fingerprint zero and link like any other.
    Repeated rows stay. A row without an id has no part in the smallest id: it takes that of its
    class, or null if the class has none. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "fingerprints")
    fingerprints(docs, id_column, text_column, words, seed).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).write.parquet(f"{folder}/prints")
    prints = spark.read.parquet(f"{folder}/prints")
    found = components(links(prints.select("fingerprint"), radius, bucket))
    rooted = prints.join(found, prints["fingerprint"] == found["node"], "left").select("fingerprint", "n", "least", F.coalesce("component", "fingerprint").alias("root"))
    rooted.write.parquet(f"{folder}/rooted")
    rooted = spark.read.parquet(f"{folder}/rooted")
    # only what is not alone in its class has to be looked up
    least = rooted.groupBy("root").agg(F.sum("n").alias("members"), F.min("least").alias("component_id")).filter("members > 1").select("root", "component_id")
    shared = rooted.join(least, "root").select(F.col("fingerprint").alias("shared"), "component_id")
    return rows.join(shared, rows["fingerprint"] == shared["shared"], "left").select(
        "doc_id", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id")
    )
