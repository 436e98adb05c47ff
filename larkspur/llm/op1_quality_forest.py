"""Quality rules with an isolation forest over rule statistics.

Rules first: a text of fewer than 50 words, or of which more than half stands in repeated three-word windows, fails.
Texts that pass are placed by an isolation forest over their rule statistics: trees of random splits, in which anomalous
documents end on short paths.  The statistics are nine: lengths of words and lines, and shares of symbols, other signs, digits,
upper-case letters, characters beyond ASCII, words in repeated windows and repeated lines.  The score above which a document
is dropped is calibrated on all labelled rows.

The forest is fitted on a bounded sample of labelled rows (``TREES`` x ``LEAF_ROWS``); statistics, scores and the
calibration cover all rows.

Defined results: a null or empty text has no words and fails; without labelled rows (or labels of one kind alone)
nothing but the rules drops a document; repeated rows give a row each; a document labelled twice counts twice; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Trees of the forest, and rows that each is grown on.
TREES, LEAF_ROWS = 100, 256
#: The least spread that a feature is taken to have.
LEAST_SPREAD = 0.01
#: Fixed values of the base rules: least words; most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled good documents that the threshold may drop, at most, as a share.
GOOD_LOST = 0.005
#: Steps of the calibration's histogram of scores.
STEPS = 2000
#: The symbols that the rule counts.
SYMBOLS = b"#*$%&|<>"

#: Other ASCII signs, upper-case letters, digits.
SIGNS, UPPER, DIGITS = b"!\"'()+,-./:;=?@[\\]^_`{}~", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"

_SYMBOL, _SIGN, _UPPER, _DIGIT = (common.byte_set(b) for b in (SYMBOLS, SIGNS, UPPER, DIGITS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_signs", "n_wide")
#: What the forest sees of a document; its length is left to the rules.
FEATURES = ("word_length", "line_length", "symbols", "signs", "digits", "upper", "wide", "repeats", "dup_lines")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _repeated(words: common.Words) -> np.ndarray:
    """Words of each text that stand in a three-word window found twice or more in the text."""
    value, begin = words.shingles(3)
    n = len(words.counts)
    if not len(value):
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        value = common.mix(value + words.text_of()[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ranked = np.sort(value)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    begin = begin[twice[place] == value]
    cover = np.zeros(len(words.hash) + 3, np.int64)
    cover[begin] += 1
    cover[begin + 3] -= 1
    return _sums(np.cumsum(cover[: len(words.hash)]) > 0, words.first)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of ``COUNTS`` of each row; one pass without a shuffle."""

    def run(batches):
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(1))
            words = common.Words(data, at)
            raw = data.tobytes()
            lines, dup_lines = np.array([_lines(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]).reshape(-1, 2).T
            starts = (data & 0xC0) != 0x80
            columns = [words.counts, _sums(~common.SPACE[data] & starts, at), _sums(_SYMBOL[data], at), dup_lines, _repeated(words), lines]
            columns += [_sums(flags, at) for flags in (_UPPER[data], _DIGIT[data], _SIGN[data], (data >= 0xC0))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def with_rules(counts: DataFrame) -> DataFrame:
    """base_failed, and the forest's features of each row."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return counts.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.log1p(F.col("word_chars") / n).alias("word_length"),
        F.log1p(F.col("n_words") / lines).alias("line_length"),
        (F.col("n_symbols") / (F.col("n_symbols") + n)).alias("symbols"),
        (F.col("n_signs") / (F.col("n_signs") + n)).alias("signs"),
        (F.col("n_digits") / chars).alias("digits"),
        (F.col("n_upper") / chars).alias("upper"),
        (F.col("n_wide") / chars).alias("wide"),
        (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("n_dup_lines") / lines).alias("dup_lines"),
    )


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray, rng: np.random.Generator, deepest: int) -> dict[str, np.ndarray]:
    """One tree over the box from low to high, as arrays: feature and threshold of each node (feature -1: a leaf),
    children, and the path length at leaves.  A cut falls anywhere in the node's box, so that empty space ends early, and on
    a feature with a chance that goes with the box's width there in units of scale, so that features in which nothing
    stands out use up few cuts."""
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "path")}

    def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        k = len(tree["feature"])
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", k), ("right", k), ("path", depth + _path(len(part)))):
            tree[name].append(v)
        wide = np.flatnonzero(high > low)
        if depth < deepest and len(part) > 1 and len(wide):
            width = (high - low)[wide] / scale[wide]
            f = int(rng.choice(wide, p=width / width.sum()))
            cut = float(rng.uniform(low[f], high[f]))
            at = np.arange(len(low)) == f
            tree["feature"][k], tree["threshold"][k] = f, cut
            tree["left"][k] = node(part[part[:, f] <= cut], low, np.where(at, cut, high), depth + 1)
            tree["right"][k] = node(part[part[:, f] > cut], np.where(at, cut, low), high, depth + 1)
        return k

    node(rows, low, high, 0)
    return {k: np.array(v) for k, v in tree.items()}


def fit_forest(rows: np.ndarray, good: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> list[dict[str, np.ndarray]]:
    """Isolation trees, each grown on random good rows in the box of all rows: a dense heap of bad rows can't hide itself."""
    rng = np.random.default_rng(seed)
    own = rows[good] if good.any() else rows
    size = min(leaf_rows, len(own))
    if not size:
        return []
    low, high, deepest = rows.min(0), rows.max(0), max(1, math.ceil(math.log2(size)))
    scale = np.maximum(own.std(0), LEAST_SPREAD)
    return [grow(own[rng.choice(len(own), size, replace=False)], low, high, scale, rng, deepest) for _ in range(trees)]


def anomaly(forest: list[dict[str, np.ndarray]], x: np.ndarray, leaf_rows: int) -> np.ndarray:
    """2 ** -(mean path length over the expected one): towards 1 for anomalous rows."""
    if not forest:
        return np.full(len(x), 0.5)
    total, every = np.zeros(len(x)), np.arange(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := t["feature"][at] >= 0).any():
            go = np.where(x[every, np.maximum(t["feature"][at], 0)] <= t["threshold"][at], t["left"][at], t["right"][at])
            at = np.where(inner, go, at)
        total += t["path"][at]
    return 2.0 ** -(total / len(forest) / max(_path(leaf_rows), 1.0))


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and goodness of at most TREES x LEAF_ROWS labelled rows that pass the rules, chosen by a hash of their id."""
    bound = TREES * LEAF_ROWS
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("l_id"), (F.col(label) > 0).alias("good"))
    labelled = stats.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("l_id"))
    n, most = labelled.count(), bound * 9 // 10
    chosen = labelled.where(common.sampled(F.xxhash64("doc_id"), F.lit(common.share_of(most, n)))) if most < n else labelled
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "good", *FEATURES).limit(bound).select("good", *FEATURES).collect()
    return np.array([tuple(r)[1:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.good for r in rows], bool)


def calibrate(scored: DataFrame, labels: DataFrame, label: str, good_lost: float = GOOD_LOST) -> float:
    """The score from which documents are dropped: of those that lose at most good_lost of the good labelled rows, the one
    that tells good from bad best; above all scores where labels are missing."""
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).alias("step")
    known = scored.where(~F.col("base_failed")).join(labels.select(F.col("doc_id").alias("l_id"), F.col(label).alias("good")).where("good is not null"), F.col("doc_id") == F.col("l_id"))
    table = np.zeros((2, STEPS))
    for r in known.groupBy(step, (F.col("good") > 0).alias("good")).count().collect():
        table[int(r.good), r.step] = r["count"]
    bad, good = (np.cumsum(t[::-1])[::-1] for t in table)
    if not bad[0] or not good[0]:
        return 2.0
    gain = np.where(good <= good_lost * good[0], bad / bad[0] - good / good[0], -1.0)
    best = int(np.argmax(gain))
    return best / STEPS if gain[best] > 0 else 2.0


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per row: doc_id, the counts, base_failed, the forest's anomaly score and kept."""
    with common.scratch(docs.sparkSession):
        scored = common.materialize(_scored(docs, labels, label), "rule-scores", keep=True)
    threshold = calibrate(scored, labels, label)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold)).withColumn("threshold", F.lit(threshold))


def _scored(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, the counts, base_failed and score of each row."""
    stats = common.materialize(with_rules(statistics(docs)), "rule-statistics")
    rows, good = labelled_sample(stats, labels, label)
    forest = docs.sparkSession.sparkContext.broadcast(fit_forest(rows, good))
    leaf_rows = min(LEAF_ROWS, max(int(good.sum()) or len(rows), 1))
    kept = ("doc_id", *COUNTS, "base_failed")

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(anomaly(forest.value, x, leaf_rows))], [*kept, "score"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
