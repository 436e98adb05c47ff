from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import op6_best_fit_packing as op
from tests.llm.rows import SCHEMA, documents, edge_texts


def plain_best_fit(sizes, lengths, preferred):
    """Best fit by looking at all open bins."""
    bins = []
    for s in sizes:
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            room = min((c for c in lengths if c >= max(s, preferred)), key=lambda c: (op.cost(c) / c, c))
            bins.append(b := [room, 0])
        b[0] -= s
        b[1] += s
    return sorted(b[1] for b in bins)


def test_bins_equal_plain_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        lengths = tuple(sorted(rng.sample([8, 16, 24, 32, 64], 3)))
        sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(60))), reverse=True)
        for preferred in lengths:
            assert sorted(op.best_fit(sizes, lengths, preferred)[2]) == plain_best_fit(sizes, lengths, preferred)


def plain_opening(sizes, lengths):
    """Best fit by looking at all open bins, each opened by trying all lengths on the list of pieces still to come."""
    bins, coming = [], sorted(sizes, reverse=True)
    while coming:
        s = coming.pop(0)
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            rates = []
            for c in lengths:
                if c >= s:
                    room = c - s
                    for t in coming:
                        room -= t if t <= room else 0
                    holds = c - room
                    rates.append((op.cost(min(x for x in lengths if x >= holds)) / holds, c))
            bins.append(b := [min(rates)[1], 0])
        b[0] -= s
        b[1] += s
    return sorted(b[1] for b in bins)


def test_openings_equal_plain_trials():
    rng = random.Random(2)
    for _ in range(60):
        lengths = tuple(sorted(rng.sample([8, 16, 24, 32, 64], 3)))
        sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(60))), reverse=True)
        assert sorted(op.best_fit(sizes, lengths)[2]) == plain_opening(sizes, lengths)


def test_sequences_hold_the_ids(spark):
    rng = random.Random(3)
    ids = {d: [rng.randrange(1000) for _ in range(rng.choice([1, 5, 30, 64, 65, 200]))] for d in range(60)}
    tokens = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>")
    packed = op.pack(tokens, F.size("ids"), (16, 32, 64), 25).cache()
    found = {r.bin_id: r for r in op.sequences(packed, tokens, (16, 32, 64)).collect()}
    back = defaultdict(dict)
    for r in packed.collect():
        assert len(found[r.bin_id].ids) <= r.bin_length
        back[r.doc_id][r.piece] = found[r.bin_id].ids[r.bin_start : r.bin_start + r.n_tokens]
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in back.items()} == ids
    assert sum(len(r.ids) for r in found.values()) == sum(map(len, ids.values()))


def test_query_packs_real_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [t for t in edge_texts() if t is None or len(t) < 50_000]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    check(op.query(spark, str(tmp_path)).collect(), want, op.LENGTHS)


def test_the_cheapest_packing_is_taken():
    sizes = np.array(sorted(np.random.default_rng(0).integers(1, 4097, 500), reverse=True))
    bins, _, length = op.pack_sizes(sizes, op.LENGTHS)
    own = sum(op.cost(c) for c in {b: n for b, n in zip(bins.tolist(), length.tolist())}.values())
    assert all(own <= sum(map(op.cost, op.downsized(op.best_fit(sizes.tolist(), op.LENGTHS, p)[2], op.LENGTHS))) + 1e-6 for p in (None, *op.LENGTHS))


def check(rows, want, lengths):
    """Every token of every document is in one place, bins don't overlap and have the least length."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.n_tokens))
        bins[r.bin_id].append((r.bin_start, r.n_tokens, r.bin_length))
    assert {k: sum(n for _, n in v) for k, v in docs.items()} == want
    for own in bins.values():
        end = 0
        for start, n, length in sorted(own):
            assert start == end
            end += n
        assert length == min(c for c in lengths if c >= end)


def test_all_pieces_are_placed(spark):
    texts = edge_texts() + [" ".join("w" * (i % 3 + 1) for _ in range(i)) for i in range(0, 300, 7)]
    want = {i: len((t or "").encode().split()) + 1 for i, t in enumerate(texts)}
    docs = documents(spark, texts, extra=True)
    for shard_rows in (op.SHARD_ROWS, 11):
        check(op.pack(docs, op.word_tokens(), (16, 64, 256), shard_rows).collect(), want, (16, 64, 256))


def test_null_and_repeated_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, 5), (None, 600), (1, 5), (1, 5), (2, None), (3, 0)], "doc_id long, n long")
    rows = op.pack(df, F.col("n")).collect()
    assert sum(r.n_tokens for r in rows) == 617 and sum(r.doc_id == 1 for r in rows) == 2
    assert op.pack(spark.createDataFrame([], SCHEMA), op.word_tokens()).count() == 0


def test_packing_by_a_column(spark):
    rng = random.Random(5)
    want = {i: rng.randrange(1, 150) for i in range(200)}
    kind = {i: rng.choice(["a", "b", "", None]) for i in want}
    docs = spark.createDataFrame([(i, n, kind[i]) for i, n in want.items()], "doc_id long, n long, kind string")
    rows = op.pack(docs, F.col("n"), (16, 64), 90, by="kind").collect()
    check(rows, want, (16, 64))
    bins = defaultdict(set)
    for r in rows:
        assert r.kind == kind[r.doc_id]
        bins[r.bin_id].add(r.kind)
    assert all(len(own) == 1 for own in bins.values())
    assert op.pack(docs, F.col("n"), (16, 64), 90).columns == [c for c in rows[0].asDict() if c != "kind"]
