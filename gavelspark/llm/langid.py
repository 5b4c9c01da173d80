"""Language identification by mixture inference.

A text is taken as a mixture of languages, each a distribution over character trigrams.
Expectation-maximisation estimates the share of each language in a document from the
likelihoods of its trigrams. Which languages take part is chosen by penalised likelihood:
beginning with the best single language, the next one stays if it raises the log-likelihood
by more than its penalty. The language of the largest share is the document's.

Trigrams are counted in Spark; what reaches the driver is one count per language and bucket.
Scoring is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.llm.rows import about, slices, texts_of

# Trigrams share this many buckets: the model has so many numbers for each language.
BUCKETS = 1 << 16
# Labelled rows to learn from, about; more are thinned out by a hash of the id.
FIT_ROWS = 20_000
UNDETERMINED = "und"

_ROUNDS, _SETTLED, _SMOOTHING = 25, 1e-3, 0.2
# A language under this share of a first estimate is not tried.
_LEAST_SHARE = 0.02
# Points of log-likelihood that a further language has to gain, as a multiple of
# log(number of trigrams). Neighbouring trigrams overlap, hence three times the usual half.
PENALTY = 1.5

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of the lower-cased letters; other characters are one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.r_[np.uint32(32), codes[keep], np.uint32(32)].astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages, and the probability of every bucket (rows) in each of them (columns)."""

    languages: tuple[str, ...]
    table: np.ndarray


def learn(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the languages named in ``language_column``, from about ``fit_rows`` rows.

    Rows without a language or a text are left out. Without any, the model knows no language.
    """
    rows = labelled.select(
        labelled[id_column].cast("long").alias("doc_id"), labelled[text_column].alias("text"), labelled[language_column].alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = about(rows, rows.select("lang").count(), fit_rows, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for text, lang in zip(texts_of(batch, "text"), batch.column("lang").to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(dtype=np.int64), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    counts += _SMOOTHING
    return Model(languages, (counts / counts.sum(axis=0)).astype(np.float32))


# The name of what no language explains.
BACKGROUND = ""


def with_background(model: Model) -> Model:
    """The model with one more component, under which every bucket is as likely as any other."""
    return Model((*model.languages, BACKGROUND), np.c_[model.table, np.full(BUCKETS, 1 / BUCKETS, dtype=np.float32)])


def shares(likelihood: np.ndarray) -> np.ndarray:
    """The shares of the languages (columns) that explain the trigrams (rows) best."""
    n, k = likelihood.shape
    share = np.full(k, 1 / k, dtype=np.float32)
    for _ in range(_ROUNDS):
        updated = share * (likelihood.T @ (1 / (likelihood @ share))) / n
        moved = np.abs(updated - share).max()
        share = updated
        if moved < _SETTLED:
            break
    return share / share.sum()


def mixture(table: np.ndarray, found: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The share of each language in a document; zero for those that are not in its set."""
    likelihood = table[found]
    likelihood = likelihood / likelihood.max(axis=1, keepdims=True)
    first = shares(likelihood)
    single = np.log(likelihood).sum(axis=0)
    chosen = [int(single.argmax())]
    best, weights = float(single[chosen[0]]), np.ones(1)
    for k in np.argsort(-first, kind="stable").tolist():
        if k in chosen or first[k] < _LEAST_SHARE:
            continue
        part = np.ascontiguousarray(likelihood[:, [*chosen, k]])
        share = shares(part)
        gained = float(np.log(part @ share).sum())
        if gained - best <= penalty * np.log(len(found)):
            break
        chosen, best, weights = [*chosen, k], gained, share
    out = np.zeros(table.shape[1])
    out[chosen] = weights
    return out


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (its share) and ``mixture`` (share by language) of every row, after columns to ``keep``.

    A null text, one without a letter, or a model without languages gives ``und`` and score 0.
    Ties between languages go to the one that sorts first. Whole texts are used, however long.
    Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shipped.value
        for batch in slices(batches, "text"):
            names, scores, mixed = [], [], []
            for text in texts_of(batch, "text"):
                found = trigrams(text) if languages else ()
                share = mixture(table, found) if len(found) else None
                best = None if share is None else int(share.argmax())
                names.append(UNDETERMINED if best is None else languages[best])
                scores.append(0.0 if best is None else min(1.0, float(share[best])))
                mixed.append([] if best is None else [(x, float(s)) for x, s in zip(languages, share) if s > 0])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in keep), batch.column("doc_id"), pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64())),
                ],
                names=[*keep, "doc_id", "lang_pred", "score", "mixture"],
            )

    rows = docs.select(*keep, docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL("doc_id long, lang_pred string, score double, mixture map<string, double>")])
    return rows.mapInArrow(run, schema)


def told(docs: DataFrame, model: Model, least_share: float = 0.0, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, of which a language of the model has the largest share, and that of ``least_share`` or more.

    Rows go where the background has the largest share: texts in scripts and languages that were
    not learned, and strings of chance letters. So do texts that are null or without a letter, and all if the
    model knows no language. Ties go to a language. A row passes Python once, with its text.
    """
    wide = with_background(model)
    shipped = docs.sparkSession.sparkContext.broadcast((len(model.languages), wide.table))
    # names may be there twice or differ in case alone
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shipped.value
        for batch in slices(batches, text):
            stays = []
            for raw in texts_of(batch, text):
                found = trigrams(raw) if known else ()
                share = mixture(table, found) if len(found) else np.zeros(1)
                stays.append(len(found) > 0 and int(share.argmax()) < known and bool(share.max() >= least_share))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.toDF(*names).mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)
