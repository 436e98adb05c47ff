"""Small tables of documents for the tests of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, extra=False):
    """Rows with ids from 0; with extra, a few columns whose names operators use inside."""
    rows = [(i, t, (langs[i] if langs else "en"), "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "hash", "word", "score", "n_tokens", "kept", "pos", "value"):
            df = df.withColumn(name, F.lit("x"))
    return df


def edge_texts():
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(20_000))
    return [None, "", " ", "\n\n", "a", "two words", "A b\tc\x0bd\x0ce\rf", "  lead and trail  ", "naïve café — 你好  x y", long, "same text here", "same text here", "x" * 5000]
