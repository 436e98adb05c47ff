from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm import op4_ppm_score as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def is_train(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


class Brute:
    """PPM with escapes and exclusion, symbol by symbol."""

    def __init__(self, texts, contexts=None):
        self.trie = defaultdict(Counter)
        for t in texts:
            s = [op.START] * 3 + list(lower(t).encode()) + [op.END]
            for i in range(3, len(s)):
                for k in range(4):
                    self.trie[tuple(s[i - k : i])][s[i]] += 1

    def log10(self, text):
        s = [op.START] * 3 + list(lower(text).encode()) + [op.END]
        total = 0.0
        for i in range(3, len(s)):
            out, excluded, p = s[i], set(), 1.0
            for k in (3, 2, 1, 0):
                seen = {c: n for c, n in self.trie.get(tuple(s[i - k : i]), {}).items() if c not in excluded}
                if not seen:
                    continue
                n, t = sum(seen.values()), len(seen)
                if out in seen:
                    p *= seen[out] / (n + t)
                    break
                p *= t / (n + t)
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        return total


def texts(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABé ") for _ in range(rng.randrange(1, 5)))
    return edge_texts() + [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("common_words", [op.COMMON_WORDS, 15, 1])
def test_scores_equal_brute_force(spark, common_words):
    rows = texts()
    train = [t for i, t in enumerate(rows) if is_train(i)]
    count = Counter()
    for t in train:
        count.update(WORD.findall(lower(t)))
        count["\n"] += 1
    n, v = sum(count.values()), len(count)
    model = Brute(train)
    found = {r.doc_id: r for r in op.score_documents(documents(spark, rows, extra=True), common.bucket(F.col("doc_id"), 7) != 2, common_words=common_words).collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(rows):
        tokens = [*WORD.findall(lower(t)), "\n"]
        r = found[i]
        assert r.train == is_train(i) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        if len(t or "") < 3000:
            assert r.score == pytest.approx(model.log10(t), rel=1e-4)


def test_the_contexts_of_the_model_have_a_bound(spark):
    docs = documents(spark, texts())
    few = op.score_documents(docs, F.lit(True), contexts=40).agg(F.sum("score")).first()[0]
    many = op.score_documents(docs, F.lit(True)).agg(F.sum("score")).first()[0]
    assert few < many < 0


def test_probabilities_of_a_context_sum_to_one(spark):
    import numpy as np

    model = op.fit(op.count_corpus(documents(spark, texts()), F.lit(True)).cache())
    assert np.allclose((10.0 ** model.table.astype(float)).reshape(-1, 256).sum(1), 1, atol=1e-4)


def test_repeated_rows_no_training_rows_and_an_empty_table(spark):
    docs = documents(spark, ["a b c", "a b"])
    twice = docs.union(docs.limit(1))
    got = sorted(op.score_documents(twice, F.lit(True), common_words=1).collect())
    assert [r.doc_id for r in got] == [0, 0, 1] and got[0] == got[1] and got[0].n_known == 4
    none = sorted(op.score_documents(docs, F.lit(False)).collect())
    assert none[0].train_tokens == 0 and none[0].n_known == 0 and none[1].score == pytest.approx(4 * math.log10(1 / 256), rel=1e-5)
    assert op.score_documents(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


@pytest.mark.parametrize("held", [0, 40])
def test_contexts_that_are_not_broadcast_count_as_well(spark, held):
    rows = texts()
    model = Brute([t for i, t in enumerate(rows) if is_train(i)])
    again = next(i for i in range(20, 60) if not is_train(i))
    twice = documents(spark, rows).union(documents(spark, rows).where(F.col("doc_id") == again))
    found = op.score_documents(twice, common.bucket(F.col("doc_id"), 7) != 2, held=held).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        if len(rows[r.doc_id] or "") < 3000:
            assert r.score == pytest.approx(model.log10(rows[r.doc_id]), rel=1e-4)
