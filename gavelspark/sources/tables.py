"""Auction events read out of the star-schema tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The state given to a nation key or event id, by remainder.
STATE_BY_REMAINDER = ("OR", "ID", "CA", "WA", "NV", "AZ")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes of input files per micro-batch, about; a larger file is one of its own. Rows of results do
# not depend on it, but whether there are any may: beyond it files come by the time of writing, and
# what depends on the order of arrival fails (run.run_carried) if that is not the order of ``seq``.
BATCH_BYTES = 1 << 36


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream, in the order in which they were written.

    The table is one file or a folder of files; without either, reading its schema fails.
    """
    schema = read_table(spark, sf_dir, name).schema
    # a pattern: a plain path would have to be a folder
    pattern = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(pattern)


def minor_units(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def state_by_remainder(number: Column) -> Column:
    states = F.array(*[F.lit(s) for s in STATE_BY_REMAINDER])
    return F.element_at(states, (F.pmod(number, F.lit(len(STATE_BY_REMAINDER))) + 1).cast("int"))


def _days(number: Column) -> Column:
    return F.make_dt_interval(days=number.cast("int"))


def persons_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    registered = F.expr("timestamp_ntz'1995-01-01 00:00:00'") + _days((F.col("c_custkey") * 37) % 2400)
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        state_by_remainder(F.col("c_nationkey")).alias("state"),
        registered.alias("ts"),
    )


def auctions_from(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("seller"),
        (2 * F.substring("o_orderpriority", 1, 1).cast("long")).alias("category"),
        minor_units("o_totalprice").alias("reserve"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderdate") + _days(F.lit(365))).alias("expires"),
    )


def bids_from(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("auction"),
        F.col("l_suppkey").alias("bidder"),
        minor_units("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("ts"),
    )


def event_bids_from(events: DataFrame) -> DataFrame:
    """Every event as a bid on one of twenty auctions, in arrival order ``seq``."""
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 20).alias("auction"),
        F.col("event_id").alias("bidder"),
        minor_units("value").alias("price"),
        "ts",
    )


def event_auctions_from(events: DataFrame) -> DataFrame:
    """The twenty auctions of ``event_bids_from``: each opens with its first sign-up."""
    first = (
        events.filter(F.col("event_type") == "signup")
        .groupBy((F.col("user_id") % 20).alias("id"))
        .agg(F.min(F.struct("event_id", "ts", "user_id")).alias("first"))
    )
    return first.select(
        "id",
        F.col("first.event_id").alias("seq"),
        F.col("first.user_id").alias("seller"),
        F.col("first.ts").alias("ts"),
        (F.col("first.ts") + _days(F.lit(15))).alias("expires"),
    )


def event_versions_from(events: DataFrame) -> DataFrame:
    """Every sign-up as a new version of one of the twenty auctions, half a step before its bid."""
    return events.filter(F.col("event_type") == "signup").select(
        (F.col("user_id") % 20).alias("id"),
        (2 * F.col("event_id") - 1).alias("seq"),
        F.col("user_id").alias("seller"),
        "ts",
        (F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("expires"),
    )


def user_bids_from(events: DataFrame) -> DataFrame:
    """Every event as a bid on the auction numbered like its user."""
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("auction"), F.col("event_id").alias("bidder"),
        minor_units("value").alias("price"), "ts",
    )


def customer_auctions_from(customer: DataFrame) -> DataFrame:
    """One auction per customer, all opened together and over at noon of one of thirty days."""
    opened = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.lit(0).cast("long").alias("seq"),
        F.col("c_nationkey").cast("long").alias("category"),
        opened.alias("ts"),
        (opened + _days(F.col("c_custkey") * 37 % 30) + F.make_dt_interval(hours=F.lit(12))).alias("expires"),
    )


def event_items_from(events: DataFrame) -> DataFrame:
    """Purchases as auctions opened by the user, ordered by ``seq``."""
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("seller"),
        F.when(F.col("event_id") % 2 == 0, 10).otherwise(9).cast("long").alias("category"),
        minor_units("value").alias("reserve"),
        "ts",
    )


def event_persons_from(events: DataFrame) -> DataFrame:
    """Sign-ups as versions of a person, ordered by ``seq``."""
    return events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.col("props").alias("city"),
        state_by_remainder(F.col("event_id")).alias("state"),
        "ts",
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons_from(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auctions_from(read_table(spark, sf_dir, "orders"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids_from(read_table(spark, sf_dir, "lineitem"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def event_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bids_from(events(spark, sf_dir))


def event_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_auctions_from(events(spark, sf_dir))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items_from(events(spark, sf_dir))


def event_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_persons_from(events(spark, sf_dir))


# The same views for the check queries.
SQL_VIEWS = {
    "person": """
        SELECT c_custkey AS id, c_name AS name, n_name AS city,
               CASE c_nationkey % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA'
                    WHEN 3 THEN 'WA' WHEN 4 THEN 'NV' ELSE 'AZ' END AS state,
               TIMESTAMP '1995-01-01' + to_days(CAST((c_custkey * 37) % 2400 AS INTEGER)) AS ts
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "auction": """
        SELECT o_orderkey AS id, o_custkey AS seller,
               2 * CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS category,
               CAST(round(o_totalprice * 100) AS BIGINT) AS reserve,
               o_orderdate AS ts, o_orderdate + INTERVAL 365 DAY AS expires
        FROM orders""",
    "bid": """
        SELECT l_orderkey AS auction, l_suppkey AS bidder,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS ts
        FROM lineitem""",
    "ebid": """
        SELECT event_id AS seq, user_id % 20 AS auction, event_id AS bidder,
               CAST(round(value * 100) AS BIGINT) AS price, ts
        FROM events""",
    "eauction": """
        SELECT user_id % 20 AS id, min(event_id) AS seq, min_by(user_id, event_id) AS seller,
               min_by(ts, event_id) AS ts, min_by(ts, event_id) + INTERVAL 15 DAY AS expires
        FROM events WHERE event_type = 'signup' GROUP BY user_id % 20""",
    "version": """
        SELECT user_id % 20 AS id, 2 * event_id - 1 AS seq, user_id AS seller, ts, ts + INTERVAL 6 HOUR AS expires
        FROM events WHERE event_type = 'signup'""",
    "ubid": """
        SELECT event_id AS seq, user_id AS auction, event_id AS bidder,
               CAST(round(value * 100) AS BIGINT) AS price, ts
        FROM events""",
    "cauction": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS category, TIMESTAMP '2024-01-01' AS ts,
               TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(c_custkey * 37 % 30 AS INTEGER)) AS expires
        FROM customer""",
    "item": """
        SELECT event_id AS seq, event_id AS id, user_id AS seller,
               CAST(CASE WHEN event_id % 2 = 0 THEN 10 ELSE 9 END AS BIGINT) AS category,
               CAST(round(value * 100) AS BIGINT) AS reserve, ts
        FROM events WHERE event_type = 'purchase'""",
    "member": """
        SELECT event_id AS seq, user_id AS id, 'user ' || user_id AS name, props AS city,
               CASE event_id % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA'
                    WHEN 3 THEN 'WA' WHEN 4 THEN 'NV' ELSE 'AZ' END AS state, ts
        FROM events WHERE event_type = 'signup'""",
}


def sql_with(query: str, *views: str) -> str:
    """The query with the named views in front of it."""
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in views]
    query = query.strip()
    if query.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + query[5:]
    return "WITH " + ",\n".join(parts) + "\n" + query
