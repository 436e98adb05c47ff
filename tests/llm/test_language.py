from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm import op2_language_id as op
from tests.llm.rows import SCHEMA, documents, edge_texts

SYLLABLES = {"en": "the ing and er ion of", "de": "der sch ung ein ß ä", "fr": "le eau ez qu é è", "es": "el ción ado ñ ar que"}


def prose(lang, rng, n):
    parts = SYLLABLES[lang].split() + ["a", "e", "o", "n"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, n=320):
    rng = random.Random(2)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return documents(spark, [prose(g, rng, rng.randrange(15, 60)) for g in langs], langs, extra=True), langs


def test_held_out_accuracy_and_undetermined(spark):
    docs, langs = table(spark)
    held_out = common.bucket(F.col("doc_id"), 5) == 0
    classifier = op.fit(docs, ~held_out)
    assert set(classifier.levels) == {"", "germanic", "romance"}
    found = {r.doc_id: r for r in op.predict_languages(docs, classifier).withColumn("held_out", held_out).collect()}
    own = [found[i].lang_pred == g for i, g in enumerate(langs) if found[i].held_out]
    assert len(own) > 40 and np.mean(own) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    edges = op.predict_languages(documents(spark, [*edge_texts(), "123 !?", "١٢٣"]), classifier).collect()
    for r, t in zip(sorted(edges), [*edge_texts(), "123 !?", "١٢٣"]):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert r.lang_pred != "und" or r.score == 0


def test_a_prediction_sees_the_text_alone(spark):
    docs, _ = table(spark, 100)
    classifier = op.fit(docs, F.lit(True))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert sorted(op.predict_languages(docs, classifier).collect()) == sorted(op.predict_languages(other, classifier).collect())


def test_no_labels_one_language_and_an_empty_table(spark):
    docs, _ = table(spark, 30)
    assert op.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r.lang_pred for r in op.predict_languages(docs, None).collect()} == {"und"}
    one = op.fit(docs.where("lang = 'en'"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in op.predict_languages(docs, one).collect()} == {("en", 1.0)}
    assert op.predict_languages(spark.createDataFrame([], SCHEMA), one).count() == 0


def test_machine_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, -1.0, 1.0)
    x = np.concatenate([rng.normal(size=(200, 5)) + y[:, None], np.ones((200, 1))], 1)
    assert np.mean(np.sign(x @ op.train_machine(x, y)) == y) > 0.95


def test_features_equal_brute_force():
    import pyarrow as pa

    texts = ["Abc abD", "", "naïve", "x"]
    got = op.features(*common.text_bytes(pa.array(texts)))
    for row, text in zip(got, texts):
        raw, total = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()), np.zeros(op.CLASSES)
        for k in range(1, op.LONGEST + 1):
            for i in range(len(raw) - k + 1):
                code = int.from_bytes(raw[i : i + k], "big") + k
                total[(code * 2654435761 % 2**32) >> (32 - op.CLASSES.bit_length() + 1)] += 1
        want = np.sqrt(total) / max(np.sqrt(total.sum()), 1e-12)
        assert np.allclose(row[:-1], want, atol=1e-6) and row[-1] == 1


def test_votes_and_ties_equal_brute_force():
    rng = np.random.default_rng(4)
    langs = ["en", "de", "nl", "fr", "es", "ru", "xx"]
    families = op.by_family(langs)
    level = {"": sorted(families), **{f: own for f, own in families.items() if len(own) > 1}}
    pairs = lambda own: [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    machines = {k: {p: rng.normal(size=4) for p in pairs(own)} for k, own in level.items()}
    model = op.Classifier(langs, machines)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    found, score = model.predict(x)

    def pick(k, row):
        own = {c: [] for c in level[k]}
        for (a, b), w in machines[k].items():
            own[a].append(float(row @ w))
            own[b].append(-float(row @ w))
        best = max(level[k], key=lambda c: (sum(m > 0 for m in own[c]), sum(own[c])))
        return best, np.mean([1 / (1 + np.exp(-2 * m)) for m in own[best]])

    for row, lang, s in zip(x, found, score):
        family, sure = pick("", row)
        want = families[family][0]
        if len(families[family]) > 1:
            want, more = pick(family, row)
            sure *= more
        assert lang == want and abs(s - sure) < 1e-4


def test_many_languages_are_all_learned_and_rows_have_few_copies(spark):
    rng = random.Random(9)
    own = [f"l{k:02d}" for k in range(20)]
    docs = documents(spark, [" ".join(f"{g}{rng.randrange(5)}" for _ in range(20)) for g in own for _ in range(12)], [g for g in own for _ in range(12)])
    classifier = op.fit(docs.union(docs.limit(5)), F.lit(True), copies=6)
    assert len(classifier.families) == 20
    found = op.predict_languages(docs, classifier).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_missing_languages_are_filled_in(spark):
    docs, langs = table(spark, 80)
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    kept = {r.doc_id: r.lang for r in op.keep_identified(some, op.fit(some, F.lit(True)), lang="lang").collect()}
    assert all(kept[i] == g for i, g in enumerate(langs) if i % 4) and np.mean([kept[i] == g for i, g in enumerate(langs)]) > 0.9


def test_sure_predictions_stand_against_labels(spark):
    docs, langs = table(spark, 200)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))
    classifier = op.fit(docs, F.lit(True))
    score = {r.doc_id: r.score for r in op.predict_languages(docs, classifier).collect()}
    for sure in (None, 0.5, 2.0):
        kept = {r.doc_id: r.lang for r in op.keep_identified(wrong, classifier, lang="lang", sure=sure).collect()}
        assert kept[7] == (langs[7] if sure is not None and score[7] >= sure else "xx")


def test_filter_keeps_all_columns(spark):
    docs, _ = table(spark, 60)
    both = docs.unionByName(documents(spark, [None, "", "12"], extra=True).withColumn("doc_id", F.col("doc_id") + 1000))
    kept = op.keep_identified(both, op.fit(docs, F.lit(True)), 0.1)
    assert kept.columns == both.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_the_sample_of_a_language_of_any_size(spark):
    from larkspur.llm import common

    for there in (10, 10**6, 10**9, 10**13):
        share = common.share_of(1000, there)
        assert 0 < share <= common.SHARES and abs(share / common.SHARES * there - min(1000, there)) < 1
    n = spark.range(1_000_000).where(common.sampled(F.xxhash64("id"), F.lit(common.share_of(1000, 1_000_000)))).count()
    assert 850 < n < 1150
    assert spark.range(50).where(common.sampled(F.xxhash64("id"), F.lit(common.share_of(1000, 50)))).count() == 50


def test_filter_keeps_columns_of_any_name_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "some words", None), (None, "some words", None), (3, "12 34", "en"), (4, None, "en")], "doc_id long, text string, lang string").withColumn("a.b", F.lit("x")).withColumn("row", F.lit(1))
    out = op.keep_identified(rows, None, lang="lang")
    assert out.columns == rows.columns and [(r.doc_id, r.text, r.lang, r["a.b"], r.row) for r in out.collect()] == [(None, "some words", None, "x", 1)] * 2
