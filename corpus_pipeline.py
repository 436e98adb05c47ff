"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents; the last
one returns the packing.  Its decisions take effect: rejected documents are gone, deleted lines and passages are gone from text
(and n_chars follows), and the language found decides which documents may share a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, op2_language_id, op3_decontaminate, op6_best_fit_packing, op7_line_dedup, op8_jaccard_join

#: Near duplicates: word shingles of five, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: From this score on the language found in a text stands against its label.
SURE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, without those in whose text no word is left."""
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go.  lang becomes the predicted one where that is sure or lang is
    missing, and the packing goes by it."""
    docs = docs.select(*COLUMNS)
    classifier = op2_language_id.fit(docs, common.bucket(F.col("doc_id"), 5) != 0)
    return op2_language_id.keep_identified(docs, classifier, lang="lang", sure=SURE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which nothing is left go."""
    return _with_text(op7_line_dedup.dedup_lines(docs.select(*COLUMNS)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op8_jaccard_join.keep_one_of_each(docs.select(*COLUMNS), WORDS, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are little else go."""
    return _with_text(op3_decontaminate.decontaminate(docs.select(*COLUMNS), common.read_table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, by its real tokens and an end token; a sequence holds documents of one language."""
    import public_tokenizers

    return op6_best_fit_packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), by="lang")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Support vector machines and the packing's search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
