from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from larkspur.llm import op11_periodic_runs as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    """(start, length, period) of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, times * q):
                found.setdefault((i, e + q), q)
            i = e + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def odd_texts():
    rng, out = random.Random(11), []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(1, 14))]
            words += (unit * rng.randrange(1, 12))[: rng.randrange(1, 80)]
            words += [str(rng.randrange(50)) for _ in range(rng.randrange(0, 6))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out + ["x " * 24, "x " * 23, "a b " * 12, "a b " * 11 + "a", "a b c d e f g h i " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h"]


@pytest.mark.parametrize("least,times", [(24, 3), (5, 2), (1, 2), (40, 4)])
def test_runs_equal_a_search_period_by_period(spark, least, times):
    texts = edge_texts()[:9] + odd_texts()
    got = {r.doc_id: r for r in op.find_runs(documents(spark, texts, extra=True), least, times).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = brute(words, least, times)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == runs, text
        assert got[i].n_words == len(words) and got[i].collapsed == collapsed(words, runs)


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 200):
        codes = rng.integers(0, 2, n)
        if n == 17:
            codes[:] = 1
        lce = op.Extensions(codes)
        for i in range(n):
            for j in range(i + 1, n):
                k = 0
                while j + k < n and codes[i + k] == codes[j + k]:
                    k += 1
                assert lce(np.array([i]), np.array([j]))[0] == k


def test_collapse_keeps_other_columns_and_texts_without_runs(spark):
    texts = ["keep   this\nas it is", "go on " * 20, None, "", "x " * 30 + "end"]
    out = op.collapse(documents(spark, texts, extra=True).withColumn("a.b", op.F.lit(7)).withColumn("runs", op.F.lit("r")))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*documents(spark, [], extra=True).columns, "a.b", "runs"]
    assert [rows[i].text for i in range(5)] == [texts[0], "go on", None, "", "x end"]
    assert all(r["a.b"] == 7 and r.runs == "r" and r.key == "x" for r in rows.values())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a " * 30, "en", "s", 1), (None, "a " * 30, "en", "s", 1), (1, None, None, None, None)], SCHEMA)
    got = sorted((str(r.doc_id), len(r.runs)) for r in op.find_runs(rows).collect())
    assert got == [("1", 0), ("None", 1), ("None", 1)]
    assert op.find_runs(rows.limit(0)).collect() == [] and op.collapse(rows.limit(0)).collect() == []


def test_a_long_text_with_runs_of_all_sizes(spark):
    rng = random.Random(2)
    unit = [str(rng.randrange(10**6)) for _ in range(90_000)]
    text = " ".join(unit * 3 + ["between"] + ["z"] * 5000 + ["p", "q"] * 3000)
    assert len(text) > 1_800_000
    (row,) = op.find_runs(documents(spark, [text])).collect()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(0, 270_000, 90_000), (270_001, 5000, 1), (275_001, 6000, 2)]


def test_query_over_its_table(spark, tmp_path):
    texts = edge_texts() + odd_texts() + [" ".join(str(i * k) for i in range(40 + k)) for k in range(60)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    n_planted = 0
    for i, text in enumerate(texts):
        words = planted(WORD.findall(text or ""), i)
        n_planted += words != WORD.findall(text or "")
        if len(words) > 3000:
            continue
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        row = got[i]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert n_planted > 5
