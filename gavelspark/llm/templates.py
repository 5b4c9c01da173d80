"""Line deduplication by a log-template tree.

A line is parsed down a tree of fixed depth: by its number of tokens (what single blanks
separate), then by its leading tokens. Words with a digit are variable from the start. In a
leaf, a token is constant at its position if lines of enough documents have it there; the
others generalise to a variable field. What remains is the line's template. Templates that
recur in enough documents and are constant enough are boilerplate: their lines are dropped,
but for the first one. A line that recurs as it is needs no template and fewer witnesses: it is
counted by its own digest, in distinct texts, whatever its fields.

The tree is a key, not a structure: leaves, tokens at positions and templates are groups that
are counted with partial sums, so the leaf of a very common line is no task of its own. Only
lines in leaves that enough documents share go further, and equal ones are generalised once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.rows import id_and_text, small_or_not, text_digest
from gavelspark.session import shared_folder

# Leading tokens that lead to a leaf.
DEPTH = 3
# Documents in which a template has to recur.
LEAST_DOCS = 20
# Distinct texts in which a line has to recur as it is.
LEAST_TEXTS = 3
# Share of a template's tokens that has to be constant.
LEAST_CONSTANT = 0.6
# Fixed value: what stands for a variable field.
FIELD = "<*>"


def _masked(text: Column) -> Column:
    """The text with a variable field for every word with a digit."""
    return F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*", FIELD)


def _leaf(line: Column, depth: int) -> Column:
    """Number of tokens and leading tokens, as one number."""
    return F.xxhash64(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", depth))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def recurring(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    depth: int = DEPTH, least_docs: int = LEAST_DOCS, least_constant: float = LEAST_CONSTANT,
) -> DataFrame:
    """The lines of recurring templates: ``doc_id``, ``digest`` of the text, line ``number`` (from 0), ``template``, ``first``.

    ``first`` marks the line of each template that stays: of the smallest id (null ids first),
    and there the first. Repeated rows (same id, same text) are one document.
    """
    document = ("doc_id", "digest")
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    rows = rows.select(*document, F.split(_masked(F.col("text")), "\n").alias("lines"))

    # a document counts once for each leaf
    own = F.array_distinct(F.transform(F.filter("lines", lambda line: ~_blank(line)), lambda line: _leaf(line, depth)))
    leaves = rows.select(F.explode_outer(own).alias("leaf")).filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"))
    folder, read = shared_folder(docs.sparkSession, "template-lines"), docs.sparkSession.read
    leaves.filter(F.col("n") >= least_docs).select("leaf").write.parquet(f"{folder}/leaves")
    # the outer form: else the texts are masked and split once more, to see whether there are lines
    split = rows.select(*document, F.posexplode_outer("lines").alias("number", "line")).filter(~_blank(F.col("line")))
    split = split.withColumn("leaf", _leaf(F.col("line"), depth))
    split.join(small_or_not(read.parquet(f"{folder}/leaves")), "leaf", "left_semi").write.parquet(f"{folder}/lines")
    lines = read.parquet(f"{folder}/lines").withColumn("name", F.xxhash64("line"))

    once = lines.groupBy("leaf", "name", *document).agg(F.first("line").alias("line"))
    kinds = once.groupBy("leaf", "name").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    tokens = kinds.select("leaf", "name", "n", F.posexplode(F.split("line", " ")).alias("position", "token"))
    constant = (
        tokens.filter(F.col("token") != FIELD).groupBy("leaf", "position", "token").agg(F.sum("n").alias("total"))
        .filter(F.col("total") >= least_docs)
    )
    fields = tokens.join(constant, ["leaf", "position", "token"], "left").groupBy("leaf", "name").agg(
        F.array_sort(F.collect_list(F.struct("position", F.when(F.col("total").isNull(), FIELD).otherwise(F.col("token")).alias("field")))).alias("fields"),
        F.count("total").alias("constants"), F.count("*").alias("tokens"),
    )
    templates = fields.filter(F.col("constants") >= F.ceil(F.lit(least_constant) * F.col("tokens"))).select(
        "leaf", "name", F.array_join(F.transform("fields", lambda x: x["field"]), " ").alias("template")
    )
    described = lines.select(*document, "number", "leaf", "name").join(templates, ["leaf", "name"])
    spot = F.struct(*document, "number")
    totals = (
        described.groupBy("template", *document).agg(F.min("number").alias("number"))
        .groupBy("template").agg(F.count("*").alias("n"), F.min(spot).alias("spot"))
        .filter(F.col("n") >= least_docs).drop("n")
    )
    return described.join(totals, "template").select(*document, "number", "template", (spot == F.col("spot")).alias("first"))


def verbatim(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_texts: int = LEAST_TEXTS) -> DataFrame:
    """The lines that recur as they are in distinct texts: ``doc_id``, ``digest`` of the text, line ``number`` (from 0), ``first``.

    Documents of the same text count once. ``first`` is as in ``recurring``; lines of white space
    do not count.
    """
    document = ("doc_id", "digest")
    rows = id_and_text(docs, id_column, text_column).withColumn("digest", text_digest(F.col("text")))
    rows = rows.select(*document, F.split("text", "\n").alias("lines"))

    # a document counts once for each line; copies are told apart once few lines are left
    own = F.array_distinct(F.transform(F.filter("lines", lambda line: line.rlike(r"\S")), text_digest))
    names = rows.select(F.explode_outer(own).alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    folder, read = shared_folder(docs.sparkSession, "verbatim-lines"), docs.sparkSession.read
    names.filter(F.col("n") >= least_texts).select("name").write.parquet(f"{folder}/names")
    split = rows.select(*document, F.posexplode_outer("lines").alias("number", "line")).filter(F.col("line").rlike(r"\S"))
    split = split.select(*document, "number", text_digest(F.col("line")).alias("name"))
    split.join(small_or_not(read.parquet(f"{folder}/names")), "name", "left_semi").write.parquet(f"{folder}/lines")
    lines = read.parquet(f"{folder}/lines")

    spot = F.struct(*document, "number")
    totals = (
        lines.groupBy("name", "digest").agg(F.min(spot).alias("spot"))
        .groupBy("name").agg(F.count("*").alias("n"), F.min("spot").alias("spot"))
        .filter(F.col("n") >= least_texts).drop("n")
    )
    return lines.join(totals, "name").select(*document, "number", (spot == F.col("spot")).alias("first"))


def dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    depth: int = DEPTH, least_docs: int = LEAST_DOCS, least_constant: float = LEAST_CONSTANT, keep_first: bool = True,
    least_texts: int | None = LEAST_TEXTS,
) -> DataFrame:
    """``row`` (all columns of a document), its ``doc_id``, ``text`` without the dropped lines, ``n_lines`` and ``dropped`` (their numbers).

    Every row is returned. Null and empty texts stay as they are; lines without a token are
    never dropped. ``keep_first`` leaves one line of each template in the corpus. Without
    ``least_texts`` lines that recur as they are go by their templates only.
    """
    found = recurring(docs, id_column, text_column, depth, least_docs, least_constant).drop("template")
    if least_texts is not None:
        # the first line of a template is the first of its own kind, so that it stays in both
        found = found.unionByName(verbatim(docs, id_column, text_column, least_texts))
    if keep_first:
        found = found.filter(~F.col("first"))
    drops = found.groupBy(F.col("doc_id").alias("_1"), F.col("digest").alias("_2")).agg(F.array_sort(F.collect_set("number")).alias("dropped"))
    rows = docs.select(F.struct("*").alias("row"), docs[id_column].cast("long").alias("doc_id"), text_digest(docs[text_column]).alias("digest"))
    joined = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_1"]) & (rows["digest"] == drops["_2"]), "left")
    joined = joined.withColumn("text", F.col("row")[text_column])
    stays = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("dropped"), i))
    return joined.select(
        "row", "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
