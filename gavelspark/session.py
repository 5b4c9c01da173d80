"""Session settings the operators count on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SETTINGS = {
    # event times are epoch-based and zone-free: one zone everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot join key is split even when the next step needs one more exchange for it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a join side is broadcast if it turns out to be small, checked at run time
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # keyed state spills to disk instead of living on the heap
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "local").startswith("local")


def _partitions_set(spark: SparkSession) -> bool:
    """Whether this session names its number of shuffle partitions."""
    return any(row.key == "spark.sql.shuffle.partitions" for row in spark.sql("SET").collect())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session; returns it."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    if is_local(spark) and not _partitions_set(spark):
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(cores))
    return spark


def build_session(app: str = "gavelspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors can reach.

    Without that setting it is under the warehouse, which a cluster shares too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
