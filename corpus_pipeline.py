"""A training corpus out of raw documents, stage by stage.

Every stage takes what the one before it kept, whole; all but the last return the columns of
``documents``. Between stages the documents are written to the shared folder, so a lost
executor costs at most the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm import decontam, langid, partenum, pieces, templates
from gavelspark.llm.plans import PIECE_MODEL, encoded_digests
from gavelspark.llm.rows import text_digest
from gavelspark.session import shared_folder
from gavelspark.sources.tables import read_table

# A document stays if a learned language has the largest share of it, and this one at least.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go, and those that no learned language explains."""
    return langid.told(docs, langid.learn(docs), LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates, but for the first of each; those left without a word go."""
    found = templates.dedup(docs)
    cut = F.size("dropped") > 0
    found = found.filter(~cut | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    changed = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return found.select(*[changed[name].alias(name) if name in changed else F.col("row")[name].alias(name) for name in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: of the smallest id, then digest; rows without an id come last.

    Rows are numbered and stored first, so ids may be null, repeated or shared by different texts.
    """
    folder, read = shared_folder(spark, "numbered"), spark.read
    docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")).write.parquet(f"{folder}/rows")
    rows = read.parquet(f"{folder}/rows")
    found = partenum.classes(rows.select("key", "row.text"), "key").filter("component_id <> doc_id")
    found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).write.parquet(f"{folder}/linked")
    linked = read.parquet(f"{folder}/linked")
    members = linked.union(linked.select(F.col("component").alias("key"), "component").distinct())
    spot = F.struct(F.col("row.doc_id").isNull().alias("last"), "row.doc_id", text_digest(F.col("row.text")).alias("digest"), "key")
    best = members.join(rows.select("key", spot.alias("spot")), "key").groupBy("component").agg(F.min("spot").alias("spot"))
    copies = members.join(best.select("spot.key"), "key", "left_anti").select("key")
    return rows.join(copies, "key", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as piece ids, with their number and digests of ids and decoded text."""
    model = pieces.read_model(PIECE_MODEL)
    # the workers go on to other stages: the table of chunks goes with the task
    return encoded_digests(docs, model, "ids", reuse=False)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

# Language shares, pieces and their ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
