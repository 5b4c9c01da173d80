"""Awkward documents for the corpus operators, and plain versions of what they compute."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "the of and tion ing onth erea wher thisle inand heron stand that was with anor ntion edly reth ounti".split()
LONG = " ".join(f"{WORDS[i * i % 17]}{i % 97}" for i in range(60_000))

# other columns, named like those that operators make on their own
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("number", T.StringType()),
    T.StructField("doc", T.LongType()), T.StructField("_1", T.StringType()), T.StructField("n_chars", T.LongType()),
])

TEXTS = {
    1: "the cat sat on the mat and looked at the moon for a very long while tonight",
    2: "the cat sat on the mat and looked at the moon for a very long while tonight",
    3: "THE CAT sat on the mat and looked at the moon for a very long while tonight too",
    4: None, 5: "", 6: "   \n\t \n", 7: "1234 !!! 5678", 8: "one", 9: "éàü ñandú Größe ſ ﬁ İstanbul Σίσυφος 中文字 🙂",
    10: "a\x00b\r\nc\x1fd <|endoftext|> ▁x  <s>", 11: LONG, 12: "x" * 5000, 13: "word " * 300,
}


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "d", 1, "n", 7, "x", None if text is None else len(text))


def awkward(spark):
    """Null ids and texts, empty and very long ones, copies, rows that are there twice, clashing columns."""
    rows = [row(i, text, None if i % 4 == 0 else "en") for i, text in TEXTS.items()]
    rows += [row(1, TEXTS[1]), row(None, TEXTS[1]), row(None, None), row(8, "another text of the same id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n, seed=1, least=20, most=200):
    """Texts of chance words, some of them edited copies of earlier ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + rng.choice(WORDS)
        else:
            words = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(least, most))]
        out.append(" ".join(words))
    return out


def documents(spark, texts):
    return spark.createDataFrame([row(i, text) for i, text in enumerate(texts)], SCHEMA).repartition(4)
