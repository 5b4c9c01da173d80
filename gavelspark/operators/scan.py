"""Running totals that no single task has to hold.

``Window.partitionBy(key).orderBy(...)`` puts all rows of a key into one task, so one
key with a third of the rows, or no key at all, ends the job. The order of such a key is
cut into nested chunks instead. Each chunk is summed up on its own, the sums are scanned
one level up (again in chunks), and what came before a chunk enters it as one more row.
Groups are then as large as a chunk, whatever the size of the key.

For keys of a few rows the sums would be as many as the rows. So rows are counted by key
first, and only hot keys go through the chunks; the others take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.functions.intervals import micros

# An order column, or an order column with the width of its chunks. Widths are plain
# numbers for numbers and interval texts such as "1 hour" for times.
OrderBy = Sequence["str | tuple[str, int | str]"]

_OPS = {"sum": F.sum, "max": F.max, "min": F.min}
_TIMES = (T.TimestampType, T.TimestampNTZType)


def chunk_of(df: DataFrame, name: str, width: int | str) -> Column:
    """Start of the chunk a value falls in; grows with the value."""
    at = F.unix_micros(F.col(name).cast("timestamp")) if isinstance(df.schema[name].dataType, _TIMES) else F.col(name)
    return at - F.pmod(at, F.lit(plain_width(width)))


def plain_width(width: int | str) -> int:
    return micros(width) if isinstance(width, str) else width


def order_names(order_by: OrderBy) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order_by]


# An order without a key also gets chunks of so many chunks, and of so many of those.
_WIDER = (1 << 20, 1 << 10)


def order_levels(df: DataFrame, order_by: OrderBy, widen: bool = False) -> tuple[DataFrame, list[str]]:
    """Add the level columns of an order, coarse to fine.

    Every column up to the last one with a width gets a chunk level and, unless it is
    that last one, a level of its own; the rest of the order is one struct. With ``widen``
    there are coarser levels above the first: however few rows a chunk holds, what is
    left for the one window over all of them is small.
    """
    specs = [(o, None) if isinstance(o, str) else tuple(o) for o in order_by]
    chunked = [i for i, (_, width) in enumerate(specs) if width is not None]
    last = chunked[-1] if chunked else 0
    levels: list[str] = []
    for i, (name, width) in enumerate(specs[: last + 1]):
        if width is not None:
            for factor in _WIDER if widen and i == 0 else ():
                if plain_width(width) * factor < 1 << 62:
                    levels.append(f"_wide{factor}")
                    df = df.withColumn(levels[-1], chunk_of(df, name, plain_width(width) * factor))
            levels.append(f"_chunk{i}")
            df = df.withColumn(levels[-1], chunk_of(df, name, width))
        if i < last:
            levels.append(name)
    tail = [name for name, _ in specs[last:]]
    if len(tail) == 1:
        return df, [*levels, tail[0]]
    return df.withColumn("_rank", F.struct(*tail)), [*levels, "_rank"]


def present(df: DataFrame, *names: str) -> DataFrame:
    """Rows with a value in each of the columns.

    Joins add such filters to their inputs on their own. Asked for beforehand, they are
    the same in every use of a frame, which lets Spark reuse its exchanges.
    """
    return df.filter(reduce(and_, [F.col(name).isNotNull() for name in names]))


# Rows of a key that one task may hold.
HOT_ROWS = 1 << 22
# The list of hot keys is broadcast if each has so many rows at least: then it is short.
LISTED_ROWS = 1 << 20
# Instead of such a number: no key is hot, or all keys are. Rows are then not counted first.
NONE_HOT, ALL_HOT = float("inf"), None


def split_keys(
    rows: DataFrame, keys: Sequence[str], hot_rows: int, weight: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary keys, and those of keys with more than ``hot_rows`` rows.

    ``weight`` counts a row as several. There is at most one hot key per ``hot_rows`` rows,
    a million in 4 * 10^12: such a list is broadcast, one of smaller keys only if it turns out
    small. If it is empty, Spark does not run what is built on the hot rows.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    # compared as one struct: from single columns Spark derives filters that set the uses of ``rows`` apart
    key = F.struct(*keys)
    hot = rows.groupBy(*keys).agg(total.alias("_rows")).filter(F.col("_rows") > hot_rows).select(key.alias("_hot"))
    if hot_rows >= LISTED_ROWS:
        hot = F.broadcast(hot)
    is_hot = key == F.col("_hot")
    return rows.join(hot, is_hot, "left_anti"), rows.join(hot, is_hot, "left_semi")


def running_before(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: OrderBy,
    measures: dict[str, tuple[str, str | Column]],
    hot_rows: float | None = HOT_ROWS,
    weight: Column | None = None,
) -> DataFrame:
    """Add, for every row, a measure over all earlier rows of its key (null at the first).

    ``measures`` maps a new column to ``(op, input)`` with op ``sum``, ``max`` or ``min``.
    Rows must be unique by key and order; key and order columns must not be null.
    ``hot_rows`` may be ``NONE_HOT`` or ``ALL_HOT``; ``weight`` counts a row as several.
    """
    if not keys or hot_rows is ALL_HOT:
        return _chunked(rows, keys, order_by, measures)
    if hot_rows == NONE_HOT:
        return _plain(rows, keys, order_by, measures)
    cold, hot = split_keys(rows, keys, hot_rows, weight)
    return _plain(cold, keys, order_by, measures).unionByName(_chunked(hot, keys, order_by, measures))


def _plain(
    rows: DataFrame, keys: Sequence[str], order_by: OrderBy, measures: dict[str, tuple[str, str | Column]]
) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(*order_names(order_by)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        *[
            _OPS[op](F.col(source) if isinstance(source, str) else source).over(earlier).alias(name)
            for name, (op, source) in measures.items()
        ],
    )


def _chunked(
    rows: DataFrame, keys: Sequence[str], order_by: OrderBy, measures: dict[str, tuple[str, str | Column]]
) -> DataFrame:
    columns = rows.columns
    df, levels = order_levels(rows, order_by, widen=not keys)
    inputs = {f"_in_{name}": op for name, (op, _) in measures.items()}
    for name, (_, source) in measures.items():
        df = df.withColumn(f"_in_{name}", F.col(source) if isinstance(source, str) else source)
    scanned = _scan(df, list(keys), levels, inputs)
    return scanned.select(*columns, *[F.col(f"_before_in_{name}").alias(name) for name in measures])


def _scan(rows: DataFrame, keys: list[str], levels: list[str], inputs: dict[str, str]) -> DataFrame:
    group = [*keys, *levels[:-1]]
    rows = rows.withColumn("_carried", F.lit(False))
    if len(levels) > 1:
        # a group without any input still needs what came before it
        sums = rows.groupBy(*group).agg(*[_OPS[op](name).alias(name) for name, op in inputs.items()])
        carried = _scan(sums, keys, levels[:-1], inputs).select(
            *group,
            *[F.col(f"_before{name}").alias(name) for name in inputs],
            F.lit(True).alias("_carried"),
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)
    # the carried row sorts first, so the frame of every other row starts with it
    earlier = (
        Window.partitionBy(*group)
        .orderBy(F.col("_carried").desc(), levels[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = [_OPS[op](name).over(earlier).alias(f"_before{name}") for name, op in inputs.items()]
    return rows.select("*", *before).filter(~F.col("_carried")).drop("_carried")


COPY_BLOCK = 1 << 20


def repeat_rows(
    df: DataFrame, copies: str, nth: str, block: int = COPY_BLOCK, source: DataFrame | None = None
) -> DataFrame:
    """Each row ``copies`` times, numbered from 1 in column ``nth``.

    A row with very many copies is cut into blocks that are spread over the tasks. Such
    rows are rare. ``source``, if given, holds the rows of ``df`` before some costly step
    that only added columns: when it shows that there are none, Spark leaves out the
    second use of ``df``.
    """
    few = df.filter(F.col(copies) <= block).withColumn(
        nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    )
    many = df.filter(F.col(copies) > block)
    if source is not None:
        row = F.struct(*source.columns)
        hot = source.filter(F.col(copies) > block).select(row.alias("_hot"))
        many = many.join(hot, row == F.col("_hot"), "left_semi")
    first = F.col("_block") * block
    spread = (
        many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / block))))
        .repartition(F.xxhash64(*df.columns, "_block"))
        .withColumn(nth, F.explode(F.sequence(first + 1, F.least(first + block, F.col(copies)))))
        .drop("_block")
    )
    return few.unionByName(spread)
