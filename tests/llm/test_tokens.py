from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import op5_token_files as files
from larkspur.llm import op9_token_counts as counts
from larkspur.llm import pieces
from tests.llm.rows import SCHEMA, documents, edge_texts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "don't", "we'll", "'s", "Hello", "world,", "123", "4 5", " ", "é", "你好", "<|endoftext|>", "!?", "\x1c", "\x85", "_a", "x" * 40, " ", "퟿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def expected(texts):
    library = Tokenizer.from_file(BPE)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_join_to_the_whole_text():
    for text in odd_texts():
        assert " ".join(pieces.split(text)) == text


def test_counts_equal_the_library(spark):
    texts = edge_texts() + odd_texts()
    got = {r.doc_id: r for r in counts.count_tokens(documents(spark, texts, extra=True), BPE).collect()}
    for i, (text, ids) in enumerate(zip(texts, expected(texts))):
        assert got[i].n_tokens == len(ids), repr(text)
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (len(ids) > 1024)


def test_counts_of_pieces_equal_their_ids():
    library = pieces.Library(BPE)
    found = list(dict.fromkeys(p for t in odd_texts() for p in [t, " " + t.strip(), *t.split()])) + [" <|endoftext|>x", " Ǆé", ""]
    for own in (found, [], found[:1], [" foreredingwh"]):
        assert library.counts(own) == [len(ids) for ids in expected(own)]
        _, spans = library.encode(own)
        assert library.counts(own) == (spans[:, 1] - spans[:, 0]).tolist()


def test_more_memory_counts_fewer_pieces_again():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("aeiouwhst", k=8)) for _ in range(300)) for _ in range(20)]
    whole = counts.whole_tokens(BPE)
    sent = {}
    for remembered in (1 << 16, 1 << 24):
        counter, n = counts.PieceCounter(BPE, whole, remembered), []
        own = counter.memo.compute
        counter.memo.compute = lambda found: (n.append(len(found)), own(found))[1]
        assert [counter([t])[0] for t in texts * 2] == [len(ids) for ids in expected(texts)] * 2
        sent[remembered] = sum(n)
    assert sent[1 << 24] < 0.6 * sent[1 << 16]


def test_whole_tokens_are_single_ids():
    whole = counts.whole_tokens(BPE)
    library = Tokenizer.from_file(BPE)
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(1).sample(sorted(whole), 500))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    texts = ["Hello world", "", None, "a  b\nc"]
    if name.endswith(".model"):
        import sentencepiece

        own = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    else:
        own = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = sorted(counts.count_tokens(documents(spark, texts), path).collect())
    assert [r.n_tokens for r in got] == own


def test_counts_of_an_empty_table_and_repeated_rows(spark):
    assert counts.count_tokens(spark.createDataFrame([], SCHEMA), BPE).count() == 0
    twice = documents(spark, ["one two"]).union(documents(spark, ["one two"]))
    assert [r.n_tokens for r in counts.count_tokens(twice, BPE).collect()] == [2, 2]


def test_files_round_trip(spark, tmp_path):
    texts = edge_texts() + odd_texts()
    folder = f"file://{tmp_path}/tokens"
    index = files.write_tokens(documents(spark, texts, extra=True), folder, BPE, shards=5)
    assert index["width"] == 2 and len(index["shards"]) > 1
    got = sorted(files.read_tokens(spark, folder).collect())
    start = 0
    for r, ids in zip(got, expected(texts)):
        ids = [*ids, 0]
        assert r.ids == ids and r.start == start and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(texts) and index["n_ids"] == start


def test_files_of_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c"), (1, None)], "doc_id long, text string")
    files.write_tokens(df, str(tmp_path / "t"), BPE, shards=3)
    got = sorted(files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 3]
    assert [r.n_tokens for r in got] == [2, 1, 3, 3]


def test_files_of_an_empty_table(spark, tmp_path):
    files.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), BPE)
    assert files.read_tokens(spark, str(tmp_path / "t")).count() == 0
