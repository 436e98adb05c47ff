from __future__ import annotations

import random
import re

import pytest

from larkspur.llm import op8_jaccard_join as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n=3, percent=90):
    sets = [grams(t, n) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_copies(seed=3):
    """Groups of near copies, chains whose ends are unlike, and texts around the least size."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz") + str(rng.randrange(3))
    out = edge_texts()
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 10, 11, 12, 13, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own[: len(own) - rng.randrange(2)]))
    chain = [word() for _ in range(100)]
    for k in range(20):
        chain = chain[:-1]
        chain.insert(0, word())
        out.append(" ".join(chain))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, percent", [(3, 90), (2, 60)])
def test_groups_equal_brute_force(spark, n, percent):
    texts = near_copies()
    want = brute(texts, n, percent)
    found = {r.doc_id: r for r in op.jaccard_groups(documents(spark, texts, extra=True), n, percent).collect()}
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 20


@pytest.mark.parametrize("listed, hot", [(1, 1), (3, 32)])
def test_very_common_grams_and_a_large_group_of_near_copies(spark, monkeypatch, listed, hot):
    """Every text holds one passage; many are near copies of one text, some of them too unlike it; any bound gives the same groups."""
    monkeypatch.setattr(op, "LIST", listed)
    monkeypatch.setattr(op, "HOT_SHARE", hot)
    monkeypatch.setattr(op, "HELD", 500)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, base = [word() for _ in range(12)], [word() for _ in range(60)]
    texts = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = word() if rng.random() < 0.7 else "common"
        texts.append(" ".join(passage + (own if k % 3 else [word() for _ in range(rng.choice([1, 2, 40]))])))
    want = brute(texts, 3, 90)
    found = {r.doc_id: r for r in op.jaccard_groups(documents(spark, texts), 3, 90).collect()}
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(texts))] == want
    assert 10 < len({c for _, c in want}) < 80


def test_only_equal_sets_at_a_hundred_percent(spark):
    texts = ["a b c d", "a b c d e", "A b c d", None]
    assert [r.component_id for r in op.jaccard_groups(documents(spark, texts), 3, 100).orderBy("doc_id").collect()] == [0, 1, 0, 3]


def test_columns_of_the_query(spark, tmp_path):
    documents(spark, ["a b c d", None]).write.parquet(f"{tmp_path}/documents.parquet")
    assert op.query(spark, str(tmp_path)).dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_long_chains_are_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.node: r.group for r in op.connected(links).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and found[1001] == 1000 and 7 in found


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base + " more", "unlike " * 3, None, "", base]
    docs = documents(spark, texts, extra=True)
    for name in ("row", "r_id", "r_hash", "g_id", "g_hash", "node", "stays", "row_hash"):
        docs = docs.withColumn(name, docs.doc_id)
    docs = docs.union(docs.where("doc_id in (0, 2, 5)"))
    kept = op.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (4, "x"), (4, "x y z w")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.jaccard_groups(df).collect()), key=str)
    assert found == [(4, 1, 4), (4, 2, 4), (5, 38, 5), (5, 38, 5), (None, 38, 5)]
    assert op.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
