from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from larkspur.llm import op6_best_fit_packing
from tests.llm.rows import documents
from tests.llm.test_decontaminate import brute as item_brute
from tests.llm.test_jaccard import brute as group_brute
from tests.llm.test_language import prose
from tests.llm.test_line_dedup import brute as line_brute


def tables(spark, folder):
    rng = random.Random(11)
    langs, texts = [], []
    for _ in range(60):
        g = rng.choice(["en", "de", "fr", "es"])
        texts.append("\n".join(prose(g, rng, 25) for _ in range(rng.randrange(1, 5))))
        langs.append(g)
    items = [prose("en", rng, 30) for _ in range(4)]
    shared = prose("en", rng, 60)
    texts[7] = texts[6]  # an exact copy
    words = texts[8].split(" ")
    texts[9] = " ".join([*words[:-1], "other"])  # a near copy
    texts[10] += "\n" + shared
    texts[11] = shared + "\n" + texts[11]
    texts[12] += " " + items[0]
    texts[13] = items[1]
    texts[14], texts[15] = None, " 12 "
    langs[20] = None
    documents(spark, texts, langs, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, items


def test_stages_equal_brute_force(spark, tmp_path):
    texts, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = sorted(want)
        own = [want[i] for i in ids]
        if name == "line_dedup":
            want = {i: t for i, t in zip(ids, line_brute(own, 30, 50)) if t.strip()}
        elif name == "jaccard_join":
            groups = group_brute(own, 5, 80)
            want = {i: t for k, (i, t) in enumerate(zip(ids, own)) if groups[k][1] == k}
        elif name == "decontaminate":
            left = {}
            for i, t in want.items():
                n, hit, _ = item_brute(t, list(enumerate(items)), 10)
                if not hit:
                    left[i] = t
                elif hit <= 0.8 * n:
                    left[i] = None  # some of it
            want = left
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        rows = docs.collect()
        assert sorted(r.doc_id for r in rows) == sorted(want), name
        assert all(r.lang in ("en", "de", "fr", "es") for r in rows)  # one had none
        for r in rows:
            assert r.n_chars == len(r.text)
            if want[r.doc_id] is None:
                assert item_brute(r.text, list(enumerate(items)), 10)[1] == 0
                want[r.doc_id] = r.text
            assert r.text == want[r.doc_id]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
        assert r.bin_length in op6_best_fit_packing.LENGTHS
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sizes == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(want)


def test_language_found_decides_what_shares_a_sequence(spark, tmp_path):
    rng = random.Random(12)
    langs = [["en", "de", "fr", "es"][k % 4] for k in range(160)]
    texts = [prose(g, rng, 60) for g in langs]
    labels = [None if k in (16, 17) else "en" if k in (41, 42, 43) else g for k, g in enumerate(langs)]  # three are labelled wrongly
    documents(spark, texts, labels).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose("en", rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(range(160)) and all(r.lang == langs[r.doc_id] for r in packed)
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, set()).add(r.lang)
    assert all(len(own) == 1 for own in bins.values()) and set.union(*bins.values()) == {"en", "de", "fr", "es"}
