"""Event generation from row numbers.

The n-th person, auction or bid is an expression of n alone, so any set of numbers can be
generated in any order, on any number of tasks, again and again with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelspark.functions.scalar import split_longs

# Out of 50 events, 1 is a person, 3 are auctions and 46 are bids.
PERSONS_PER_ROUND, AUCTIONS_PER_ROUND, BIDS_PER_ROUND = 1, 3, 46
EVENTS_PER_ROUND = PERSONS_PER_ROUND + AUCTIONS_PER_ROUND + BIDS_PER_ROUND

FIRST_ID = 1000
FIRST_CATEGORY, CATEGORIES = 10, 5
RECENT = 100  # how far back bids and sellers reach
HOT_EVERY = 100  # one id in this many is hot
FIRST_NAMES = ("Ada", "Boris", "Chidi", "Dana", "Emre", "Fiona", "Goro", "Hana", "Ivo", "Jun")
LAST_NAMES = ("Abel", "Brandt", "Castro", "Diaz", "Eriksen", "Fukuda", "Greene")
PLACES = (
    ("Portland", "OR"), ("Bend", "OR"), ("Boise", "ID"), ("San Diego", "CA"), ("Oakland", "CA"),
    ("Seattle", "WA"), ("Reno", "NV"), ("Phoenix", "AZ"),
)

# Two multiplicative generators modulo the Mersenne prime 2^31 - 1.
PRIME, STEP_A, STEP_B = 2_147_483_647, 48_271, 69_621


def mixed(n: Column, salt: int) -> Column:
    """A pseudo-random number below 2^31 - 1 for a row number; products stay within a long."""
    seed = F.pmod(n + salt * 7919, F.lit(PRIME)) + 1
    return (seed * STEP_A % PRIME) * STEP_B % PRIME


def _pick(options: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def _recent_id(n: Column, known: Column, salt: int) -> Column:
    """An id among the ``known`` ones so far: three times in four a hot one, else a recent one."""
    hot = known - known % HOT_EVERY
    recent = F.greatest(known - mixed(n, salt + 1) % RECENT, F.lit(0))
    return FIRST_ID + F.when(mixed(n, salt) % 4 > 0, hot).otherwise(recent)


def _time(n: Column, start_ms: int, step_us: int) -> Column:
    return F.lit(start_ms) + F.floor(n * step_us / 1000).cast("long")


def gen_persons(numbers: DataFrame, n: str = "id", start_ms: int = 0, step_us: int = 1000, salt: int = 0) -> DataFrame:
    i = F.col(n)
    place = mixed(i, salt + 3)
    card = F.concat_ws(" ", *[F.lpad((mixed(i, salt + 4 + k) % 10_000).cast("string"), 4, "0") for k in range(4)])
    name = F.concat(_pick(FIRST_NAMES, mixed(i, salt + 1)), F.lit(" "), _pick(LAST_NAMES, mixed(i, salt + 2)))
    return numbers.select(
        (FIRST_ID + i).alias("id"),
        name.alias("name"),
        F.concat(F.lit("p"), i.cast("string"), F.lit("@example.org")).alias("emailAddress"),
        card.alias("creditCard"),
        _pick([city for city, _ in PLACES], place).alias("city"),
        _pick([state for _, state in PLACES], place).alias("state"),
        _time(i, start_ms, step_us * EVENTS_PER_ROUND // PERSONS_PER_ROUND).alias("dateTime"),
        F.lit("").alias("extra"),
    )


def gen_auctions(numbers: DataFrame, n: str = "id", start_ms: int = 0, step_us: int = 1000, salt: int = 0) -> DataFrame:
    i = F.col(n)
    at = _time(i, start_ms, step_us * EVENTS_PER_ROUND // AUCTIONS_PER_ROUND)
    initial = 100 + mixed(i, salt + 11) % 10_000
    persons = F.floor(i / AUCTIONS_PER_ROUND).cast("long") * PERSONS_PER_ROUND
    return numbers.select(
        (FIRST_ID + i).alias("id"),
        F.concat(F.lit("item "), i.cast("string")).alias("itemName"),
        F.concat(F.lit("lot number "), (mixed(i, salt + 12) % 1000).cast("string")).alias("description"),
        initial.alias("initialBid"),
        (initial + mixed(i, salt + 13) % 10_000).alias("reserve"),
        at.alias("dateTime"),
        (at + 1000 * (1 + mixed(i, salt + 14) % 100)).alias("expires"),
        _recent_id(i, persons, salt + 15).alias("seller"),
        (FIRST_CATEGORY + mixed(i, salt + 17) % CATEGORIES).alias("category"),
        F.lit("").alias("extra"),
    )


def gen_bids(numbers: DataFrame, n: str = "id", start_ms: int = 0, step_us: int = 1000, salt: int = 0) -> DataFrame:
    i = F.col(n)
    rounds = F.floor(i / BIDS_PER_ROUND).cast("long")
    return numbers.select(
        _recent_id(i, rounds * AUCTIONS_PER_ROUND, salt + 21).alias("auction"),
        _recent_id(i, rounds * PERSONS_PER_ROUND, salt + 23).alias("bidder"),
        (100 + mixed(i, salt + 25) % 1_000_000).alias("price"),
        _time(i, start_ms, step_us * EVENTS_PER_ROUND // BIDS_PER_ROUND).alias("dateTime"),
        F.lit("").alias("extra"),
    )


def row_numbers(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, rows, 1, partitions)


def live_numbers(spark: SparkSession, per_second: int) -> DataFrame:
    """An endless stream of row numbers; feed it to a generator."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return stream.select(F.col("value").alias("id"))


def parse_schedule(schedules: DataFrame, text: str = "schedule", keys: Sequence[str] = ()) -> DataFrame:
    """``rate_ms_rate_ms...`` as one row (pos, rate, duration_ms) per pair; a trailing odd number is dropped."""
    numbers = split_longs(text)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(1)), lambda i: i % 2 == 0),
        lambda i: F.struct(numbers[i].alias("rate"), numbers[i + 1].alias("duration_ms")),
    )
    long_enough = schedules.filter(F.size(numbers) >= 2)
    return long_enough.select(*keys, F.posexplode(pairs).alias("pos", "pair")).select(
        *keys, F.col("pos").cast("long").alias("pos"), "pair.rate", "pair.duration_ms"
    )


def _schedule_ends(segments: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    # a schedule is a handful of segments, so its running total is a plain window
    so_far = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("_end_ms", F.sum("duration_ms").over(so_far)).withColumn(
        "_events", F.sum(F.floor(F.col("rate") * F.col("duration_ms") / 1000).cast("long")).over(so_far)
    )


def schedule_remaining(
    segments: DataFrame, elapsed_ms: int | Column, keys: Sequence[str] = (), pos: str = "pos"
) -> DataFrame:
    """What is left of a schedule after some time: whole segments go, the current one is shortened."""
    elapsed = F.lit(elapsed_ms) if isinstance(elapsed_ms, int) else elapsed_ms
    left = F.col("_end_ms") - elapsed
    rest = _schedule_ends(segments, keys, pos).filter(left > 0)
    return rest.withColumn("duration_ms", F.least(F.col("duration_ms"), left)).drop("_end_ms", "_events")


def schedule_offsets(numbers: DataFrame, schedule: Sequence[tuple[int, int]], n: str = "id") -> DataFrame:
    """Add ``offset_ms``: when the n-th event falls in a schedule of (rate, duration_ms).

    Events beyond the schedule are not part of it and are dropped.
    """
    offset = F.lit(None).cast("long")
    first = start = 0
    bounds = []
    for rate, duration in schedule:
        count = rate * duration // 1000
        bounds.append((first, first + count, start, rate))
        first, start = first + count, start + duration
    for low, high, begin, rate in reversed(bounds):
        if high > low:
            at = F.lit(begin) + F.floor((F.col(n) - low) * 1000 / rate).cast("long")
            offset = F.when((F.col(n) >= low) & (F.col(n) < high), at).otherwise(offset)
    return numbers.withColumn("offset_ms", offset).filter(F.col("offset_ms").isNotNull())
