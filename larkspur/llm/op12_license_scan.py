"""License scan by diagonal voting.

Templates are short notices and phrases.  All windows of ``K`` words of all texts are joined in Spark to the places of the same windows in the
templates.  A pair of places votes for its diagonal, the place in the text less that in the template: an unbroken copy lies on one, a
copy with words put in or left out on several near each other.  Votes are added up by text, template and diagonal; diagonals no further
apart than a template allows are merged; of those with votes enough for the allowed number of changed words (each takes K windows at
most), each word of the template is looked up in the text on the merged diagonals, and a span is found if enough of them stand there.

How it scales: one pass turns texts into 64-bit hashes of windows, which meet the templates in a broadcast join: templates are
an argument, of ``MOST_TEMPLATE_WORDS`` words at most (checked), not data.  Only hits are shuffled, after they are added up in the tasks; a group is a
diagonal of one text, or the diagonals of one template in it.  A second pass verifies; what it looks up is broadcast up to ``FEW`` texts with
candidates, and joined by key beyond.

Defined results: words are runs of characters other than the ASCII ones that are no letters or digits, A-Z lower-cased; null, empty and wordless
texts have no spans; rows of equal id and text share one result; a template of fewer words than K is never found and refused; equal
spans of several templates are all given; spans come by first word, then label, then last word; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common


@dataclass(frozen=True)
class Template:
    label: str
    #: Percent of its words that must stand in a text.
    percent: int
    text: str

    @property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8").translate(_WORD_BYTES).split()

    @property
    def least(self) -> int:
        """Words that must be found."""
        return -(-len(self.words) * self.percent // 100)

    @property
    def slack(self) -> int:
        """Words that may be missing, so how far the diagonals of one copy are apart."""
        return len(self.words) - self.least

    @property
    def votes(self) -> int:
        return max(1, len(self.words) - K + 1 - K * self.slack)


#: Words of a window.
K = 3
MOST_TEMPLATE_WORDS = 1_000_000
#: Texts with candidates that may be broadcast.
FEW = 100_000

#: The phrases of the base rule, each whole.
PHRASES = (
    Template("mit", 100, "under the mit license"),
    Template("apache-2", 100, "apache license version 2"),
    Template("cc-by-nc", 100, "cc by nc"),
)

#: Public notices, and the sentences by which texts name their license.
NOTICES = (
    Template("mit", 85, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2", 85, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("bsd", 85, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", 85, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", 100, "gnu general public license"),
    Template("lgpl", 100, "gnu lesser general public license"),
    Template("mpl-2", 85, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("isc", 85, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", 85, "This is free and unencumbered software released into the public domain"),
    Template("cc-by", 85, "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", 85, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("reserved", 100, "all rights reserved"),
)

#: Bytes of words as they are (A-Z lower-cased), all others as spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TABLE = np.frombuffer(_WORD_BYTES, np.uint8)

NULL_ID = -(2**63)
SPANS = "array<struct<label:string,first:bigint,last:bigint,share:double,template:int>>"


def _hashes(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    words = common.Words(_TABLE[data], at)
    value, first = words.shingles(K)
    ends = np.searchsorted(words.text_of()[first], np.arange(len(words.counts) + 1))
    value = common.signed(value)
    return [value[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _grams(texts: list[bytes]) -> list[np.ndarray]:
    return _hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """x, template and t: the hash of each window of each template, and where it stands."""
    sizes = [len(t.words) for t in templates]
    if sum(sizes) > MOST_TEMPLATE_WORDS or min(sizes, default=K) < K:
        raise ValueError(f"templates have {K} words each at least and {MOST_TEMPLATE_WORDS} in all at most")
    rows = [(int(x), i, t) for i, own in enumerate(_grams([t.text.encode("utf-8") for t in templates])) for t, x in enumerate(own)]
    return spark.createDataFrame(rows, "x long, template int, t int")


def windows(docs: DataFrame) -> DataFrame:
    """k, r, place and x of all windows of all texts of (k, r, text)."""

    def run(batches):
        for part in common.slices(batches):
            found = _hashes(*common.text_bytes(part.column(2)))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            xs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), xs], ["k", "r", "xs"])

    return docs.mapInArrow(run, "k long, r long, xs array<long>").select("k", "r", F.posexplode("xs").alias("place", "x"))


def candidates(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """k, r and the merged diagonals of each template with votes enough: template and its diagonals."""
    spark = docs.sparkSession
    needs = spark.createDataFrame([(i, t.slack, t.votes) for i, t in enumerate(templates)], "template int, slack int, needed int")
    hits = windows(docs).join(F.broadcast(places(spark, templates)), "x")
    votes = hits.groupBy("k", "r", "template", (F.col("place") - F.col("t")).alias("diagonal")).agg(F.count("*").alias("votes"))
    votes = votes.join(F.broadcast(needs), "template")
    near = Window.partitionBy("k", "r", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(near) > F.col("slack")).cast("int")
    placed = votes.withColumn("copy", F.sum(F.coalesce(apart, F.lit(0))).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = placed.groupBy("k", "r", "template", "copy", "needed").agg(F.sum("votes").alias("votes"), F.collect_list("diagonal").alias("diagonals")).where("votes >= needed")
    return merged.groupBy("k", "r").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))


def _verified(words: list[bytes], template: Template, diagonals: list[int]) -> tuple[int, int, int]:
    """How many words of the template stand on the diagonals, and the first and last place of those."""
    own, places_found, n = template.words, [], 0
    for t, w in enumerate(own):
        here = [t + d for d in diagonals if 0 <= t + d < len(words) and words[t + d] == w]
        n += bool(here)
        places_found += here
    return n, min(places_found, default=0), max(places_found, default=0)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, few: int = FEW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words and spans (label, first and last word, share of the template's words, number of the template)."""
    k, r = F.coalesce(docs[f"`{doc_id}`"].cast("long"), F.lit(NULL_ID)), F.xxhash64(docs[f"`{text}`"])
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"), k.alias("k"), r.alias("r"))
    with common.scratch(docs.sparkSession):
        found = common.materialize(candidates(rows.select("k", "r", "text"), templates), "license-candidates", keep=True)
    found = F.broadcast(found) if found.count() <= few else found

    def run(batches):
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(1))
            raw = _TABLE[data].tobytes()
            solid = _TABLE[data] != 32
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            begins = at[:-1][np.diff(at) > 0]
            first[begins] = solid[begins]
            sums = np.concatenate([[0], np.cumsum(first)])
            spans = []
            for i, own in enumerate(part.column(2).to_pylist()):
                words, out = raw[at[i] : at[i + 1]].split() if own else [], set()
                for x in own or ():
                    template = templates[x["template"]]
                    n, a, b = _verified(words, template, sorted(x["diagonals"]))
                    if n >= template.least:
                        out.add((a, template.label, b, n / len(template.words), x["template"]))
                spans.append([{"label": label, "first": a, "last": b, "share": share, "template": k} for a, label, b, share, k in sorted(out)])
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("template", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    return rows.join(found, ["k", "r"], "left").select("doc_id", "text", "found").mapInArrow(run, f"doc_id long, n_words long, spans {SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.read_table(spark, sf_dir, "documents"))
    found = found.withColumn("base", F.filter("spans", lambda s: s["template"] < len(PHRASES)))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("spans").alias("labels"), score.alias("score"))


_VALUES = ",\n    ".join(f"({i}, '{t.label}', [{', '.join(repr(w.decode()) for w in t.words)}], {t.least}, {t.slack}, {t.votes})" for i, t in enumerate(PHRASES + NOTICES))

ORACLE_SQL = rf"""
WITH template(template, label, tw, least, slack, needed) AS (VALUES
    {_VALUES}
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), win AS (
  SELECT doc_id, place, array_to_string(w[place + 1 : place + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS place FROM doc)
), spot AS (
  SELECT template, t, array_to_string(tw[t + 1 : t + 3], ' ') AS x FROM (SELECT template, tw, unnest(range(len(tw) - 2)) AS t FROM template)
), voted AS (
  SELECT doc_id, template, place - t AS diagonal, count(*) AS votes FROM win JOIN spot USING (x) GROUP BY ALL
), chained AS (
  SELECT v.*, slack, needed, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > slack THEN 1 ELSE 0 END AS apart FROM voted v JOIN template USING (template)
), placed AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS copy FROM chained
), merged AS (
  SELECT doc_id, template, copy, list(diagonal) AS diagonals FROM placed GROUP BY doc_id, template, copy, needed HAVING sum(votes) >= needed
), looked AS (
  SELECT m.doc_id, m.template, m.copy, u.t, m.d + u.t AS place FROM (SELECT doc_id, template, copy, unnest(diagonals) AS d FROM merged) m
  JOIN (SELECT template, tw, unnest(range(len(tw))) AS t FROM template) u ON u.template = m.template
  JOIN doc ON doc.doc_id = m.doc_id WHERE m.d + u.t BETWEEN 0 AND len(w) - 1 AND w[m.d + u.t + 1] = tw[u.t + 1]
), span AS (
  SELECT DISTINCT doc_id, template, label, first, share FROM (
    SELECT doc_id, template, copy, min(place) AS first, max(place) AS last, count(DISTINCT t) AS n FROM looked GROUP BY doc_id, template, copy) JOIN template USING (template), LATERAL (SELECT n / len(tw) AS share)
  WHERE n >= least
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE template < {len(PHRASES)}) AS n_base, min(first) FILTER (WHERE template < {len(PHRASES)}) AS first_word, max(first) FILTER (WHERE template < {len(PHRASES)}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE template < {len(PHRASES)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM span GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN summed USING (doc_id)
"""
