from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from larkspur.llm import op1_quality_forest as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def texts():
    rng = random.Random(5)
    many = ["".join(rng.choice(["a ", "b ", "cc\n", "d\n", "é", "#", " ", "||", "\x85", "\x1c", "\t"]) for _ in range(rng.randrange(400))) for _ in range(200)]
    return edge_texts() + many


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_equal_brute_force(spark):
    found = {r.doc_id: r for r in op.score_quality(documents(spark, texts(), extra=True), labels(spark, [])).collect()}
    for i, text in enumerate(texts()):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), repr(text)
        assert r.kept == (not r.base_failed)


def test_forest_finds_symbol_junk_and_keeps_prose(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = [" ".join(word() for _ in range(80)) for _ in range(300)]
    junk = [" ".join(word() + "***" for _ in range(80)) for _ in range(30)]
    rows = [(i, int(i < 300), 0) for i in range(0, 330, 2)] + [(None, 1, 0), (1, None, 0)]
    found = {r.doc_id: r for r in op.score_quality(documents(spark, prose + junk), labels(spark, rows)).collect()}
    assert sum(found[i].kept for i in range(300)) >= 294
    assert sum(found[i].kept for i in range(300, 330)) <= 2


def test_forest_finds_shouting_and_repeated_short_lines(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = ["\n".join(" ".join(word() for _ in range(8)) for _ in range(12)) for _ in range(300)]
    loud = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(30)]
    # lines of one word between unique lines: no window of three words is found twice
    lines = ["\n".join(("menu" if i % 2 else f"{word()} {word()} {word()} {word()}") for i in range(40)) for _ in range(30)]
    rows = [(i, int(i < 300), 0) for i in range(0, 360, 2)]
    found = {r.doc_id: r for r in op.score_quality(documents(spark, prose + loud + lines), labels(spark, rows)).collect()}
    assert not any(r.base_failed for r in found.values())
    assert sum(found[i].kept for i in range(300)) >= 294
    assert sum(found[i].kept for i in range(300, 330)) <= 2
    assert sum(found[i].kept for i in range(330, 360)) <= 2


def test_scores_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4))
    forest = op.fit_forest(rows, np.ones(300, bool), trees=5, leaf_rows=64)
    x = np.concatenate([rows[:50], rng.normal(size=(20, 4)) * 9])

    def walk(tree, row, k=0):
        if tree["feature"][k] < 0:
            return tree["path"][k]
        return walk(tree, row, tree["left" if row[tree["feature"][k]] <= tree["threshold"][k] else "right"][k])

    want = [2 ** -(np.mean([walk(t, row) for t in forest]) / op._path(64)) for row in x]
    assert np.allclose(op.anomaly(forest, x, 64), want)


def test_calibration_takes_the_best_allowed_threshold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, bool(i % 10 == 0), float(s)) for i, s in enumerate(np.round(rng.random(400), 3))]
    known = [(i, int(rng.random() < 0.9), 0) for i in range(0, 400, 2)]
    found = op.calibrate(spark.createDataFrame(rows, "doc_id long, base_failed boolean, score double"), labels(spark, known), "quality", 0.1)
    score = {i: s for i, failed, s in rows if not failed}
    good, bad = ([int(score[i] * op.STEPS) for i, q, _ in known if i in score and q == want] for want in (1, 0))
    gains = [(sum(b >= t for b in bad) / len(bad) - sum(g >= t for g in good) / len(good)) if sum(g >= t for g in good) <= 0.1 * len(good) else -1 for t in range(op.STEPS)]
    best = max(gains)
    assert found == (gains.index(best) / op.STEPS if best > 0 else 2.0)


def test_null_ids_repeated_rows_and_contract(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(60)), "short"]
    docs = spark.createDataFrame([(None, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[1])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(1, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    found = op.query(spark, str(tmp_path))
    want = [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")]
    assert found.dtypes[:8] == want
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "1", "2", "None"]


def test_tree_isolates_an_outlier():
    rows = np.concatenate([np.random.default_rng(0).normal(size=(500, 2)), [[50.0, 50.0]]])
    score = op.anomaly(op.fit_forest(rows, np.zeros(501, bool)), rows, 256)
    assert score.argmax() == 500


def test_empty_table(spark):
    assert op.score_quality(spark.createDataFrame([], SCHEMA), labels(spark, [(1, 1, 0)])).count() == 0
