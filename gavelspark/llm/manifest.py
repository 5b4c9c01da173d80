"""A manifest of a dataset: a tree of digests by time-forward processing, with a proof for every row.

Rows of one key (say a source) are the leaves of a tree in a given order; the trees' tops are the
leaves of one more tree. A node is labelled by the last leaf it covers and its level, so children
come before their parent. The forward sweep takes nodes in label order; a priority queue, ordered
by label, delivers each digest to the parent. The reversed sweep takes the same labels backwards,
and the queue delivers to every child what its proof goes on with: the siblings above it.

The sweeps work on blocks of 4,096 neighbouring nodes, three levels, each in a task. There the queue
holds no more than a run of each level. What leaves a block is delivered through
a stored table, dealt and sorted by label: Spark's shuffle is the part of the queue that lies outside
memory. A third of all rows under one key, or all of them, are blocks like any others.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gavelspark.llm.rows import small_or_not
from gavelspark.session import shared_folder

FAN_OUT = 16
# Levels that a task sweeps.
LEVELS = 3
BLOCK = FAN_OUT**LEVELS

Label = tuple[int, int]
Step = tuple[str, str]

STEPS = "array<struct<before: string, after: string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def digest_of(*values: Column) -> Column:
    """sha256 of values in turn: ``-`` if null, else number of UTF-8 bytes, colon, value."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.sha2(F.concat(*parts), 256)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def forward(digests: Sequence[str], levels: int) -> tuple[str, list[tuple[Label, list[tuple[int, str]]]]]:
    """The digest of a block ``levels`` above its nodes, and of every inner node, by label, the places and digests of its children."""
    last = len(digests) - 1
    queue: list[tuple[Label, int, str]] = []
    records = []

    def send(place: int, level: int, digest: str) -> None:
        if level < levels:
            width = FAN_OUT ** (level + 1)
            receiver = (min(place - place % width + width - 1, last), level + 1)
            heappush(queue, (receiver, place, digest))

    top = digests[0]
    for place, digest in enumerate(digests):
        send(place, 0, digest)
        while queue and queue[0][0][0] == place:
            label, children = queue[0][0], []
            while queue and queue[0][0] == label:
                _, child, digest = heappop(queue)
                children.append((child, digest))
            top = _digest("".join(digest for _, digest in children))
            records.append((label, children))
            send(*label, top)
    return top, records


def backward(n: int, levels: int, records: list[tuple[Label, list[tuple[int, str]]]], above: list[Step]) -> list[list[Step]]:
    """For each of the ``n`` nodes of a block its siblings (left and right of it) level by level, and then ``above``."""
    out: list[list[Step]] = [[]] * n
    # the largest label comes first
    queue: list[tuple[Label, list[Step]]] = [((-(n - 1), -levels), above)]
    left = list(records)
    while queue:
        (place, level), steps = heappop(queue)
        if not level:
            out[-place] = steps
            continue
        _, children = left.pop()
        for i, (child, _) in enumerate(children):
            before = "".join(digest for _, digest in children[:i])
            after = "".join(digest for _, digest in children[i + 1 :])
            heappush(queue, ((-child, level + 1), [(before, after), *steps]))
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The digest at the end of a proof."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof in a row."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["before"], step["after"])), "")


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    height = F.lit(0)
    for level in range(15):
        height = height + (n > FAN_OUT**level).cast("int")
    return height


def _placed(rows: DataFrame, order: Sequence[str], folder: str) -> DataFrame:
    """``tree``, ``at`` (place of the row among those of its tree), ``height``, ``digest``, ``row`` of rows that have ``tree``, ``digest``, ``row``.

    Ranges of the order are sorted and numbered each on its own; how many rows of a tree lie in
    earlier ranges is summed over one row for each range and tree.
    """
    spark = rows.sparkSession
    by = ["tree", *order, "digest", "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt.select("tree", "digest", "row", F.monotonically_increasing_id().alias("_n")).write.parquet(f"{folder}/numbered")
    numbered = spark.read.parquet(f"{folder}/numbered").withColumn("_range", F.shiftright("_n", 33))
    spans = numbered.groupBy("_range", "tree").agg(F.min("_n").alias("_low"), F.count("*").alias("_rows"))
    spans.write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    whole = Window.partitionBy("tree")
    earlier = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = spans.select("_range", "tree", (earlier - F.col("_low")).alias("_shift"), F.sum("_rows").over(whole).alias("_total"))
    starts.write.parquet(f"{folder}/starts")
    joined = numbered.join(small_or_not(spark.read.parquet(f"{folder}/starts")), ["_range", "tree"])
    return joined.select("tree", (F.col("_n") + F.col("_shift")).alias("at"), _height(F.col("_total")).alias("height"), "digest", "row")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))


def _swept(table: pa.Table):
    """Digests of a block in order, the order, levels to sweep here, and what was found."""
    order = np.argsort(table.column("at").to_numpy(), kind="stable")
    digests = table.column("digest").take(pa.array(order)).to_pylist()
    levels = min(LEVELS, table.column("height")[0].as_py())
    return order, digests, levels, forward(digests, levels)


def _up(nodes: DataFrame) -> DataFrame:
    """One node for each block."""

    def sweep(table: pa.Table) -> pa.Table:
        _, _, levels, (top, _) = _swept(table)
        tree, block, height = (table.column(name)[0].as_py() for name in ("tree", "block", "height"))
        return pa.table({"tree": [tree], "at": pa.array([block], pa.int64()), "height": pa.array([height - levels], pa.int32()), "digest": [top]})

    blocked = _blocked(nodes.select("tree", "at", "height", "digest"))
    return blocked.groupBy("tree", "block").applyInArrow(sweep, "tree string, at long, height int, digest string")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``tree``, ``at``, ``steps``, ``top``, ``root`` and ``row`` of every node; ``above`` has the first five of every block."""
    row = nodes.schema["row"].dataType
    schema = T.StructType().add("tree", "string").add("at", "long").add("steps", T._parse_datatype_string(STEPS)).add("top", "string").add("root", "string").add("row", row)

    def sweep(table: pa.Table, head: pa.Table) -> pa.Table:
        order, digests, levels, (_, records) = _swept(table)
        after = [(step["before"], step["after"]) for step in head.column("steps")[0].as_py()]
        found = backward(len(digests), levels, records, after)
        flat = [step for steps in found for step in steps]
        values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], names=["before", "after"])
        offsets = np.r_[0, np.cumsum([len(steps) for steps in found])].astype(np.int32)
        same = {name: pa.array([head.column(name)[0].as_py()] * len(found), pa.string()) for name in ("top", "root")}
        own = table.select(["tree", "at", "row"]).take(pa.array(order))
        return pa.table({
            "tree": own.column("tree"), "at": own.column("at"), "steps": pa.ListArray.from_arrays(pa.array(offsets), values), **same, "row": own.column("row"),
        })

    left = _blocked(nodes).groupBy("tree", "block")
    right = above.withColumnRenamed("at", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(sweep, schema)


def _tops(nodes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each forward sweep, lowest first, and the tree's tops."""
    spark, passes = nodes.sparkSession, [nodes]
    left = nodes.agg(F.max("height")).first()[0] or 0
    while True:
        path = f"{folder}/up{len(passes)}"
        _up(passes[-1]).write.parquet(path)
        found = spark.read.parquet(path)
        left -= LEVELS
        if left <= 0:
            return passes, found
        passes.append(found.withColumn("row", F.lit(None).cast("int")))


def _proofs(passes: list[DataFrame], above: DataFrame, folder: str) -> DataFrame:
    """Deliver from the tops to the leaves; only what the leaves get is not stored."""
    spark = above.sparkSession
    for number, nodes in reversed(list(enumerate(passes))):
        found = _down(nodes, above.select("tree", "at", "steps", "top", "root"))
        if not number:
            return found
        found.drop("row").write.parquet(f"{folder}/down{number}")
        above = spark.read.parquet(f"{folder}/down{number}")


def prove(leaves: DataFrame, tree: str = "source", order: Sequence[str] = ("doc_id",), leaf: str = "leaf") -> DataFrame:
    """All columns of ``leaves``, and ``steps``, ``subroot`` and ``root``, for every row.

    ``leaf`` holds digests as hex text. Leaves of one tree ascend by ``order``, nulls first; rows that
    are equal in it by digest, and equal ones change places without a difference. Trees ascend by key,
    null first, then by bytes. Runs of 16 nodes become one until one is left; a lone leaf is its own
    subroot. ``steps`` are the siblings left and right of the path, from the leaf to the root. An empty
    table has no root and no rows. Columns named like the new ones are replaced.
    """
    spark: SparkSession = leaves.sparkSession
    folder = shared_folder(spark, "manifest")
    kept = leaves.drop("steps", "subroot", "root")
    # null comes before all other keys
    key = F.coalesce(F.concat(F.lit("="), kept[tree].cast("string")), F.lit(""))
    rows = kept.select(key.alias("tree"), kept[leaf].alias("digest"), *[kept[name].alias(f"_by{i}") for i, name in enumerate(order)], F.struct("*").alias("row"))
    rows.write.parquet(f"{folder}/leaves")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/leaves")
    placed = _placed(stored, [f"_by{i}" for i in range(len(order))], f"{folder}/low")
    low, tops = _tops(placed, f"{folder}/low")

    trees = tops.select(F.lit("").alias("tree"), F.col("tree").alias("_key"), "digest", F.struct(F.col("tree").alias("key"), "digest").alias("row"))
    high, roots = _tops(_placed(trees, ["_key"], f"{folder}/high"), f"{folder}/high")
    begin = roots.select("tree", "at", F.array().cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("top"), F.col("digest").alias("root"))
    subroots = _proofs(high, begin, f"{folder}/high")
    subroots = subroots.select(F.col("row.key").alias("tree"), F.lit(0).cast("long").alias("at"), "steps", F.col("row.digest").alias("top"), "root")
    subroots.write.parquet(f"{folder}/subroots")
    found = _proofs(low, spark.read.parquet(f"{folder}/subroots"), f"{folder}/low")
    return found.select("row.*", "steps", F.col("top").alias("subroot"), "root")
