from __future__ import annotations

import hashlib
import random
import re

import pytest

from larkspur.llm import op7_line_dedup as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def selected(own, least, sure):
    """(first line, lines, hash) of the units of a document (lines as (place, text, words)) that are the least from some line on."""
    units = []
    for i in range(len(own)):
        words, e = 0, i
        while words < least and e < len(own):
            words += own[e][2]
            e += 1
        if words >= least:
            units.append((i, e - i, number(",".join(str(number(x)) for _, x, _ in own[i:e]))))
    before = [sum(w for _, _, w in own[:i]) for i in range(len(own))]
    chosen = set()
    for i in range(len(own)):
        inside = [u for u in units if u[0] >= i and before[u[0]] - before[i] <= sure - least]
        low = min((u[2] for u in inside), default=None)
        chosen.update(u for u in inside if u[2] == low)
    return sorted(chosen)


def brute(texts, least, sure):
    """Texts (in order of id) without later copies of runs, fingerprint by fingerprint."""
    split = [(t or "").split("\n") for t in texts]
    lines = [[(i, x, len(WORD.findall(x))) for i, x in enumerate(s) if WORD.search(x)] for s in split]
    first, out = {}, []

    def near(own, at, step, most):
        """Lines from at on, as long as the words before them are fewer than most."""
        words = 0
        while 0 <= at < len(own) and words < most:
            if step < 0 and words + own[at][2] > most:
                return
            yield own[at][1]
            words += own[at][2]
            at += step

    for d, own in enumerate(lines):
        gone = set()
        for i, n, f in selected(own, least, sure):
            if f not in first:
                first[f] = (d, i)
                continue
            source, si = lines[first[f][0]], first[f][1]
            a, b = i, i - 1
            for x, y in zip(near(own, i - 1, -1, sure), near(source, si - 1, -1, sure)):
                if x != y:
                    break
                a -= 1
            for x, y in zip(near(own, i, 1, least + sure), near(source, si, 1, least + sure)):
                if x != y:
                    break
                b += 1
            gone.update(range(a, b + 1))
        whole = set()
        for k in sorted(gone):
            whole.add(own[k][0])
            if k - 1 in gone:
                whole.update(range(own[k - 1][0], own[k][0]))
        short = "\n".join(x for i, x in enumerate(split[d]) if i not in whole)
        out.append(texts[d] if not whole else short if WORD.search(short) else "")
    return out


def cases(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 9]))) for _ in range(14)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    texts = []
    for _ in range(90):
        own = []
        for _ in range(rng.randrange(5)):
            own += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(pool) + str(rng.randrange(99))]
        texts.append("\n".join(own))
    return texts + ["\n".join(["x y"] * 40), "\n".join(["x y"] * 40), "\n\n" + texts[5] + "\n"] + edge_texts()


@pytest.mark.parametrize("seed, least, sure", [(1, 6, 10), (2, 10, 25), (3, 3, 3)])
def test_texts_equal_brute_force(spark, seed, least, sure):
    texts = cases(seed)
    docs = documents(spark, texts, extra=True)
    for name in ("row", "k", "r", "row_k", "stretches", "cut", "short", "_gone", "_gone_k", "_gone_r"):
        docs = docs.withColumn(name, docs.doc_id)
    out = op.dedup_lines(docs, least, sure)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, least, sure)


def test_every_repeated_run_of_enough_words_goes_but_the_first(spark):
    passage = "\n".join(f"line {i} of the passage that repeats" for i in range(12))
    texts = [f"own start {i}\n{passage}\nown end {i}" for i in range(6)]
    got = {r.doc_id: r.text for r in op.dedup_lines(documents(spark, texts)).collect()}
    assert got[0] == texts[0] and all(got[i] == f"own start {i}\nown end {i}" for i in range(1, 6))


def test_fewer_units_are_joined_than_there_are(spark):
    texts = ["\n".join(f"line {i} of text {k} goes on" for i in range(60)) for k in range(5)]
    every = op.units(op.line_hashes(documents(spark, texts)), 12, 40).cache()
    assert 0 < every.where("selected").count() < 0.6 * every.count()


@pytest.mark.parametrize("seed", range(3))
def test_a_long_enough_run_always_leaves(spark, seed):
    """A run of SURE_WORDS words anywhere between other lines is found, and one of fewer than LEAST_WORDS stays."""
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 15)))
    run, short = [line() for _ in range(4)], "a line of a few words"
    while sum(len(x.split()) for x in run) < op.SURE_WORDS:
        run.append(line())
    texts = ["\n".join([line() for _ in range(rng.randrange(9))] + run + [line() for _ in range(rng.randrange(9))] + [short]) for _ in range(8)]
    got = {r.doc_id: r.text.split("\n") for r in op.dedup_lines(documents(spark, texts)).collect()}
    for i in range(1, 8):
        assert got[i] == [x for x in texts[i].split("\n") if x not in run] and short in got[i]


def test_no_python_in_the_plan(spark):
    plan = op.dedup_lines(documents(spark, ["a\nb", None]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    text = "\n".join(f"some words stand here {i}" for i in range(10))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "x")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in op.dedup_lines(df).collect()), key=str) == [(7, ""), (7, ""), (7, "x"), (None, text)]
    assert op.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
