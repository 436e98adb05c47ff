from __future__ import annotations

import random
import re

import pytest

from larkspur.llm import op12_license_scan as op
from tests.llm.rows import SCHEMA, documents, edge_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(words, templates):
    """(label, first, share, template) of all spans, diagonal by diagonal over all places."""
    found = set()
    for k, template in enumerate(templates):
        own = [w.decode() for w in template.words]
        votes = {}
        for d in range(-len(own), len(words)):
            votes[d] = sum(words[t + d : t + d + op.K] == own[t : t + op.K] for t in range(len(own) - op.K + 1) if t + d >= 0)
        groups = []
        for d in sorted(d for d, v in votes.items() if v):
            if groups and d - groups[-1][-1] <= template.slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            if sum(votes[d] for d in group) < template.votes:
                continue
            hits = {(t, t + d) for d in group for t, w in enumerate(own) if 0 <= t + d < len(words) and words[t + d] == w}
            n = len({t for t, _ in hits})
            if n >= template.least:
                found.add((template.label, min(p for _, p in hits), max(p for _, p in hits), n / len(own), k))
    return found


def texts_with_notices(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(op.PHRASES + op.NOTICES).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(["the", "xyz", "license", "of"])] * rng.randrange(2)
                words = words or ["a"]
            parts += [" ".join(words), " ".join(rng.choice(["under", "the", "mit", "cc", "by", "nc", "software", "é"]) for _ in range(rng.randrange(6)))]
        out.append(rng.choice([" ", "\n", "-", ". "]).join(parts))
    return out + ["cc by nc " * 7, "CC-BY-NC CC BY NC", "under the mit license", "under the MIT", "apache license version 2.0", "all rights reserved"]


def rows_of(df):
    return {r.doc_id: {(s.label, s.first, s.last, s.share, s.template) for s in r.spans} for r in df.collect()}


@pytest.mark.parametrize("few", [100_000, 0])
def test_spans_equal_a_search_of_all_diagonals(spark, few):
    texts = edge_texts()[:9] + texts_with_notices(1, 60)
    got = rows_of(op.scan_licenses(documents(spark, texts, extra=True), few=few))
    for i, text in enumerate(texts):
        assert got[i] == brute(words_of(text), op.PHRASES + op.NOTICES), text


def test_changed_notices_are_found(spark):
    rng = random.Random(4)
    texts = []
    for template in op.NOTICES:
        words = template.text.split()
        for _ in range(template.slack // 2):
            words[rng.randrange(len(words))] = "changed"
        if template.slack > 3:
            words.insert(len(words) // 2, "added")
        texts.append("before it " + " ".join(words) + " after it")
    got = {r.doc_id: {s.label for s in r.spans} for r in op.scan_licenses(documents(spark, texts)).collect()}
    assert all(t.label in got[i] for i, t in enumerate(op.NOTICES))


def test_clean_texts_have_no_label(spark):
    texts = ["permission to use the software is a matter of the license", "the terms of the public domain", "nc by cc", "mit license under the"]
    assert all(not v for v in rows_of(op.scan_licenses(documents(spark, texts))).values())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "cc by nc", "en", "s", 1), (None, "cc by nc", "en", "s", 1), (None, "none", "en", "s", 1), (3, None, None, None, None)], SCHEMA)
    got = sorted((str(r.doc_id), r.n_words, [(s.label, s.first) for s in r.spans]) for r in op.scan_licenses(rows).collect())
    assert got == [("3", 0, []), ("None", 1, []), ("None", 3, [("cc-by-nc", 0)]), ("None", 3, [("cc-by-nc", 0)])]
    assert op.scan_licenses(rows.limit(0)).collect() == []


def test_templates_are_checked(spark):
    with pytest.raises(ValueError):
        op.scan_licenses(documents(spark, ["a"]), (op.Template("x", 100, "two words"),))


def test_a_very_long_text(spark):
    text = "word and word " * 200_000 + "cc by nc " * 1000 + op.NOTICES[0].text
    (row,) = op.scan_licenses(documents(spark, [text])).collect()
    assert sum(s.template == 2 for s in row.spans) == 1000 and ("mit", 603_000) in {(s.label, s.first) for s in row.spans}


def test_query_has_the_places_of_the_phrases(spark, tmp_path):
    texts = edge_texts() + texts_with_notices(2, 80)
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = words_of(text)
        found = [(label, a) for label, phrase in BASE for a in range(len(words)) if words[a : a + len(phrase.split())] == phrase.split()]
        starts = [a for _, a in found]
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for x, _ in found}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(",")) and 0 <= row.score <= 1
