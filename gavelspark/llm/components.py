"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.session import shared_folder


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of its neighbourhood."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select("v", "u"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    others = links.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.union(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) of all nodes but the components' smallest.

    ``links`` has two integer columns. Links of a node with itself and nulls count for nothing.
    Each round is written to the shared folder, where the next one reads it.
    """
    spark = links.sparkSession
    first, second = links.columns
    folder = shared_folder(spark, "components")
    current = links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v"), (F.col(first) != F.col(second)).alias("apart"))
    current = current.filter("apart").select("u", "v").distinct()
    marks, number = None, 0
    while True:
        path = f"{folder}/{number}"
        current.write.parquet(path)
        current = spark.read.parquet(path)
        found = tuple(current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
        if found == marks or not found[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        marks, number = found, number + 1
        current = _small_star(_large_star(current))
