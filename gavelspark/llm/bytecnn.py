"""A byte-level convolutional network that scores texts, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Every byte becomes a small
learned vector, learned filters look at each chunk, each filter keeps its largest answer over
the document, and these maxima are combined into one probability. As chunks overlap by half, a
filter is the sum of what its two halves say of neighbouring half chunks: every half is
multiplied once.

Learning takes a bounded sample of labelled rows to the driver. Scoring is one pass over the
rows without a shuffle; a document is worked off in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.rows import about, id_and_text, slices, texts_of

# Bytes of half a chunk, numbers of a byte's vector, filters.
HALF, WIDTH, FILTERS = 8, 6, 32
# Bounds of the sample to learn from: rows, and bytes of text in all, about.
FIT_ROWS, FIT_BYTES = 4_000, 12_000_000
_EPOCHS, _STEPS, _BATCH, _RATE, _DECAY, _SEED = 10, 600, 32, 4e-3, 1e-4, 20260101
# Half chunks that are multiplied at a time.
_PART = 1 << 15


@dataclass(frozen=True)
class Network:
    """``embed`` (257, WIDTH): 256 stands for no byte; ``filters`` (HALF * WIDTH, 2 * FILTERS): first and second halves."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    @staticmethod
    def constant(share: float) -> Network:
        """A network that gives every text the same score."""
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(np.zeros((257, WIDTH), np.float32), np.zeros((HALF * WIDTH, 2 * FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))


def halves(text: str) -> np.ndarray:
    """The bytes of a text in rows of half a chunk, at least two; 256 fills the last."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.full(max(2, -(-len(raw) // HALF)) * HALF, 256, dtype=np.int16)
    out[: len(raw)] = raw
    return out.reshape(-1, HALF)


def answers(network: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest answer of each filter in a document, and the chunk that gave it."""
    best, where = np.full(FILTERS, -np.inf, dtype=np.float32), np.zeros(FILTERS, dtype=np.int64)
    for start in range(0, len(rows) - 1, _PART):
        part = rows[start : start + _PART + 1]
        said = network.embed[part].reshape(len(part), -1) @ network.filters
        chunk = said[:-1, :FILTERS] + said[1:, FILTERS:]
        at = chunk.argmax(axis=0)
        top = chunk[at, np.arange(FILTERS)]
        where = np.where(top > best, at + start, where)
        best = np.maximum(best, top)
    return best + network.bias, where


def score(network: Network, text: str) -> float:
    pooled = np.maximum(answers(network, halves(text))[0], 0)
    return float(1 / (1 + np.exp(-(pooled @ network.weight + network.offset))))


def fit(texts: list[str], labels: list[int], epochs: int | None = None) -> Network:
    """A network learned by gradient descent; the same rows in the same order give the same network.

    Few rows are gone through more often.
    """
    truth = np.asarray(labels, dtype=np.float32)
    if not len(truth) or truth.min() == truth.max():
        return Network.constant(float(truth.mean()) if len(truth) else 0.5)
    epochs = epochs or max(_EPOCHS, -(-_STEPS * _BATCH // len(truth)))
    random = np.random.default_rng(_SEED)
    share = float(truth.mean())
    values = {
        "embed": random.normal(0, 0.5, (257, WIDTH)).astype(np.float32),
        "filters": random.normal(0, (2 * HALF * WIDTH) ** -0.5, (HALF * WIDTH, 2 * FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weight": random.normal(0, 0.1, FILTERS).astype(np.float32),
        "offset": np.float32(np.log(share / (1 - share))),
    }
    first = {name: np.zeros_like(value) for name, value in values.items()}
    second = {name: np.zeros_like(value) for name, value in values.items()}
    rows = [halves(text) for text in texts]
    every = np.arange(FILTERS)
    step = 0
    for epoch in range(epochs):
        rate = _RATE * (1 - epoch / epochs) + 1e-5
        order = random.permutation(len(rows))
        for begin in range(0, len(order), _BATCH):
            network = Network(**values)
            slope = {name: np.zeros_like(value) for name, value in values.items()}
            picked = order[begin : begin + _BATCH]
            for i in picked.tolist():
                raw, where = answers(network, rows[i])
                pooled = np.maximum(raw, 0)
                error = 1 / (1 + np.exp(-(pooled @ network.weight + network.offset))) - truth[i]
                slope["offset"] += error
                slope["weight"] += error * pooled
                back = error * network.weight * (raw > 0)
                slope["bias"] += back
                # only the chunk with the largest answer has a part in it
                for half, columns in ((0, every), (1, every + FILTERS)):
                    seen = rows[i][where + half]
                    slope["filters"][:, columns] += network.embed[seen].reshape(FILTERS, -1).T * back
                    np.add.at(slope["embed"], seen, (network.filters[:, columns].T * back[:, None]).reshape(FILTERS, HALF, WIDTH))
            step += 1
            for name, value in values.items():
                g = slope[name] / len(picked) + _DECAY * value
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                moved = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                values[name] = (value - moved).astype(np.float32)
    return Network(values["embed"], values["filters"], values["bias"], values["weight"], float(values["offset"]))


def learn(
    docs: DataFrame, labels: DataFrame, label_column: str, id_column: str = "doc_id", text_column: str = "text",
    fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES,
) -> Network:
    """A network from about ``fit_rows`` labelled rows and ``fit_bytes`` bytes of text at most.

    Rows without an id, a text or a label are left out; without two labels all scores are equal.
    """
    texts = id_and_text(docs, id_column, text_column).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    marks = labels.select(labels[id_column].cast("long").alias("doc_id"), labels[label_column].cast("int").alias("label"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    total, size = marks.count(), texts.agg(F.avg(F.octet_length("text")).alias("size")).first()["size"] or 0.0
    wanted = max(1, int(min(fit_rows, fit_bytes / max(size, 1.0))))
    sample = about(texts, total, wanted, "doc_id").join(about(marks, total, wanted, "doc_id"), "doc_id")
    # chance may bring long texts together: the longest go while the sample is over its bytes
    found = sample.select("doc_id", "label", "text").toPandas().sort_values(["doc_id", "label", "text"])
    sizes = found["text"].str.len().sort_values(kind="stable")
    found = found.loc[found.index.isin(sizes.index[sizes.cumsum() <= 2 * fit_bytes])]
    return fit(found["text"].tolist(), (found["label"] > 0).astype(int).tolist())


def predict(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row.

    Null is scored as the empty text. Whole texts are read, in parts if they are long. Equal
    texts get equal scores; repeated rows and null ids stay; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = [score(shipped.value, text) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")
