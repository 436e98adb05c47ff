from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from larkspur.llm import op13_phrase_mining as op
from tests.llm.rows import SCHEMA, documents, edge_texts


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, most=4, least=30, percent=80):
    """{(lang, phrase): (a, l, r, n, score)} of rows of (lang, text)."""
    f, out = defaultdict(Counter), {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        frequent = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        swallowed = set()
        for w, longer in frequent.items():
            for k in range(2, len(w)):
                swallowed |= {w[i : i + k] for i in range(len(w) - k + 1) if 100 * longer >= percent * counts[w[i : i + k]]}
        for w, a in frequent.items():
            if w not in swallowed:
                score, k = min((2000000 * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w)))
                out[lang, " ".join(w)] = (a, counts[w[:k]], counts[w[k:]], n, score)
    return out


def ranked(found, top):
    out = {}
    for lang in {lang for lang, _ in found}:
        own = sorted(((-v[4], -v[0], p.encode(), v) for (x, p), v in found.items() if x == lang))
        out |= {(lang, i): (p.decode(), *v) for i, (_, _, p, v) in enumerate(own[:top], 1)}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    fixed = ["New York city hall", "in spite of", "the the the the the", "à la carte menu", "New York"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(["the", "a", "of", "spite", "York", "x'y", "é", "in"]))
            parts.append(rng.choice([" ", " ", " ", "\t ", ", ", "\n", "?!", " \x0b"]))
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, (lang, t) in enumerate(rows)], SCHEMA)


def got(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("most,least,percent", [(4, 30, 80), (2, 5, 80), (5, 3, 50), (3, 1, 100)])
def test_phrases_equal_a_count_of_all_windows(spark, most, least, percent):
    rows = corpus(1, 400) + [("en", None), ("en", ""), (None, ".,;")]
    assert got(op.mine_phrases(table(spark, rows), most, least, percent)) == brute(rows, most, least, percent)


@pytest.mark.parametrize("most_named", [0, 3, 20])
def test_ids_that_are_joined_by_key_give_the_same(spark, most_named, monkeypatch):
    monkeypatch.setattr(op, "ROW", 40)
    rows = corpus(2, 300)
    assert got(op.mine_phrases(table(spark, rows), least=4, most_named=most_named)) == brute(rows, least=4)


def test_best_of_each_language_with_ties(spark):
    rows = corpus(3, 300)
    found = op.best_phrases(op.mine_phrases(table(spark, rows), least=2), 7)
    assert {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()} == ranked(brute(rows, least=2), 7)


def test_empty_tables_clashing_names_and_long_texts(spark):
    assert op.mine_phrases(documents(spark, [])).collect() == []
    assert op.mine_phrases(documents(spark, [None, "", " "])).collect() == []
    texts = edge_texts() + ["one two three " * 150_000]
    docs = documents(spark, texts, extra=True).withColumn("f", op.F.lit(1)).withColumn("a.b", op.F.lit(2))
    assert got(op.mine_phrases(docs)) == brute([("en", t) for t in texts])


def test_scores_are_exact_beyond_64_bits(spark):
    level = spark.createDataFrame([(0, "en", "a b", 9 * 10**17, [10**18, 9 * 10**17], [10**18 + 1, 9 * 10**17])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    (row,) = op._scored(level, 2).collect()
    assert row.score == 2000000 * 9 * 10**17 // (2 * 10**18 + 1)


def test_query_over_its_table(spark, tmp_path):
    rows = corpus(4, 1500)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op.query(spark, str(tmp_path))
    assert dict(out.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}
    assert {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect()} == ranked(brute(rows), 2000)
