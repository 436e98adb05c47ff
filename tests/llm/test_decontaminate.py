from __future__ import annotations

import random
import re

from larkspur.llm import op3_decontaminate as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    found, hit, own = set(), set(), words(text)
    for key, item in items:
        w = words(item)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in grams:
                found.add(str(key))
                hit.update(range(i, i + n))
    return len(own), len(hit), sorted(found)


def cases(seed=2):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "dd"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 5, 8, 12]))) for k in range(12)] + [(99, None), (100, "...")]
    return [text(rng.randrange(60)) for _ in range(80)] + edge_texts(), items


def test_matches_equal_brute_force_with_one_block_and_with_several(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (op.BLOCK_WORDS, 20):
        for window in (4, 10):
            found = {r.doc_id: r for r in op.match_items(documents(spark, texts, extra=True), bench, window, block_words).collect()}
            for i, text in enumerate(texts):
                hit = sum(s.end - s.start for s in found[i].spans)
                assert (found[i].n_words, hit, found[i].items) == brute(text, items, window), (window, block_words, text)


def test_removal_leaves_no_hit_and_clean_rows_alone(spark):
    texts, items = cases(4)
    items = [(k, t) for k, t in items if len(words(t)) >= 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, extra=True)
    for block_words in (op.BLOCK_WORDS, 20):
        out = op.decontaminate(docs, bench, 5, 0.6, block_words=block_words)
        assert out.columns == docs.columns
        left = {r.doc_id: r.text for r in out.collect()}
        for i, text in enumerate(texts):
            _, hit, _ = brute(text, items, 5)
            if not hit:
                assert left[i] == text
            elif i in left:
                assert brute(left[i], items, 5)[1] == 0


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.match_items(documents(spark, ["a b"]), none).collect()[0].n_words == 2
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op.match_items(spark.createDataFrame([], SCHEMA), some).count() == 0
    assert op.decontaminate(documents(spark, ["a b"]), none).collect()[0].text == "a b"


def test_results_do_not_depend_on_the_size_of_a_block(spark):
    texts, items = cases(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(6)) for k in range(10)]
    covered = " tail ".join(passages)
    nested = " ".join(["p0w0 p0w1 p0w2", passages[1], "p0w3 p0w4 p0w5"])
    texts = [*texts, covered, nested + " and twelve more words of which no item has any at all, so it stays", None]
    items = [(k, t) for k, t in items if len(words(t)) >= 5] + [(200 + k, p) for k, p in enumerate(passages)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, extra=True)
    once, several = (sorted(map(tuple, op.decontaminate(docs, bench, 5, 0.8, block_words=n).collect()), key=lambda r: r[0]) for n in (op.BLOCK_WORDS, 6))
    assert once == several
    left = {r[0]: r[1] for r in several}
    assert len(texts) - 3 not in left and "p0" not in left[len(texts) - 2] and left[len(texts) - 1] is None


def test_equal_and_huge_items_make_no_large_block(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(3000))
    items = [("a", "one two three four five")] * 200 + [("b", long), ("c", "same same " * 400), (None, "null id item of words")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    sizes = [sum(len(words(t)) for _, t in block.value[1]) for block in op.item_blocks(benchmark, 5, 200)]
    assert sum(sizes) < 2 * 3900 and max(sizes) < 600
    texts = [long[200:900], "x " + " ".join(long.split()[1990:2003]) + " y", "one two three four five", "same " * 30, "clean", None]
    found = {r.doc_id: r for r in op.match_items(documents(spark, texts), benchmark, 5, 200).collect()}
    for i, t in enumerate(texts):
        n, hit, keys = brute(t, [(k or "", x) for k, x in set(items)], 5)
        assert (found[i].n_words, sum(s.end - s.start for s in found[i].spans), found[i].items) == (n, hit, keys)


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 1), (2, "x a b c y", 2)], "doc_id long, text string, n long").withColumnRenamed("n", "a.b")
    for block_words in (1000, 3):
        out = op.decontaminate(rows, spark.createDataFrame([("i", "a b c"), ("j", "q r s")], "item_id string, text string"), 3, 0.8, 1, block_words)
        assert out.columns == ["doc_id", "text", "a.b"]
        assert sorted((str(r.doc_id), r.text, r["a.b"]) for r in out.collect()) == [("2", "x  y", 2), ("None", " d e f", 1), ("None", " d e f", 1)]
