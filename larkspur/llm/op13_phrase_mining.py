"""Phrase collocation mining by hierarchical pair naming.

Words that occur often enough in a language get ids, joined to all positions.  Then, level by level, two neighbouring ids of phrases of
k - 1 words (which overlap in k - 2) make a pair; pairs are counted over all texts, frequent ones get an id of their own, and it
replaces the two at the first one's position.  A phrase of k words holds only frequent phrases of k - 1, so none is missed.  The pair
(left, right) of a phrase is its two parents: along them come the counts of its first and last words for the cuts, and the other way
each phrase tells its parents how frequent it is, which settles what a longer one swallows: of all longer ones around a phrase the
most frequent is longer by one word.

How it scales: texts are read twice, once to count words and once for their ids; then only ids are read, from tables in the shared folder,
each some 100,000 positions a row.  Tasks add up pairs before they are shuffled.  Of a level's ids at most ``MOST_NAMED`` are sent to the
tasks, the most frequent; positions of all others are joined by key, so that no hot key takes part in that join.  Nothing but those goes through
the driver.  The best phrases of a language are chosen in ``SALTS`` groups first.

Defined results: pieces and words as in ``PIECE`` and ``SPACE``, A-Z lower-cased; null and empty texts have no words; a null language is
``und``, one with a row like any other; repeated rows count each time, and ids are not read; one piece is never cut, whatever its length;
scores are integers by exact decimal arithmetic; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common

#: Characters between pieces, and between words of a piece.
PIECE, SPACE = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
#: Words of a phrase at most, times that it occurs at least, and percent of it that a longer one must reach to swallow it.
MOST_WORDS, LEAST, PERCENT = 4, 30, 80
#: Phrases of a language in the report.
TOP = 2000
#: Ids of a level that are sent to the tasks; positions of the others are joined.
MOST_NAMED = 500_000
#: Distinct words, and pairs, that a task adds up before it hands them on.
HELD_WORDS, HELD_PAIRS = 300_000, 1_000_000
#: Positions of a row of ids, unless a single piece is longer.
ROW = 100_000
#: Groups of the phrases of a language.
SALTS = 32

_LOWER = bytes(common.LOWER)
_SPACED = bytes.maketrans(PIECE + SPACE, b" " * (len(PIECE) + len(SPACE)))
#: Ends of pieces become commas between spaces; no word has a comma.
_PIECED = bytes.maketrans(PIECE + SPACE, b"," * len(PIECE) + b" " * len(SPACE))


def _raw(part: pa.RecordBatch):
    """Language and lower-cased bytes of each text."""
    data, at = common.text_bytes(part.column(1))
    raw = common.LOWER[data].tobytes()
    return zip(part.column(0).to_pylist(), (raw[a:b] for a, b in zip(at[:-1], at[1:])))


def count_words(rows: DataFrame) -> DataFrame:
    """lang, word and f of all words of rows of (lang, text)."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, counts in held.items():
                words = pa.array([w.decode("utf-8") for w in counts], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts.values(), pa.int64())], ["lang", "word", "f"])
            held.clear()

        for part in common.slices(batches):
            for lang, raw in _raw(part):
                held[lang].update(raw.translate(_SPACED).split())
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def with_ids(frequent: DataFrame, tag: str) -> DataFrame:
    """frequent, as a table, with ids from 0 on: numbers of rows within a task, on top of the sums of the tasks before."""
    placed = common.materialize(frequent.withColumn("id", F.monotonically_increasing_id()), tag)
    sizes = placed.groupBy(F.shiftright("id", 33).alias("task")).count().orderBy("task").collect()  # a row a task
    base, ends = [], 0
    for task, n in sizes:
        base.append((task, ends - (task << 33)))
        ends += n
    bases = placed.sparkSession.createDataFrame(base, "task long, base long")
    return placed.join(F.broadcast(bases), F.shiftright("id", 33) == F.col("task")).withColumn("id", F.col("id") + F.col("base")).drop("task", "base")


def _sent(ids: DataFrame, most: int) -> int:
    """The least f of the ids that are sent to the tasks: a power of two which no more than ``most`` of them reach."""
    sizes = dict(ids.groupBy(F.floor(F.log2("f")).cast("int").alias("power")).count().collect())  # at most 64 rows
    power, total = 63, 0
    while power >= 0 and total + sizes.get(power, 0) <= most:
        total += sizes.get(power, 0)
        power -= 1
    return 1 << (power + 1)


class Ids(NamedTuple):
    """A table of rows of ids, each the bytes of integers of a width."""

    table: DataFrame
    kind: str


def _kind(n: int) -> str:
    return "<i4" if n < 1 << 31 else "<i8"


def _rows(parts, key: pa.DataType | None = None):
    """Rows of ids, as bytes, under keys of their own; if ``key`` is given, with the places left open and the two keys of each."""
    task, k = TaskContext.get().partitionId() << 33, 0
    for ids, *open_ in parts:
        columns = [pa.array([task + k]), pa.array([ids.tobytes()], pa.binary())]
        if key:
            columns += [pa.array([x], pa.list_(kind)) for x, kind in zip(open_, (pa.int64(), key, key))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "places", "x", "y"][: len(columns)])
        k += 1


def _joined(table: DataFrame, rest: DataFrame, kind: str) -> DataFrame:
    """table with its open places filled by ``rest`` (x, y and id), joined by key."""
    open_ = table.select("row", F.explode(F.arrays_zip("places", "x", "y")).alias("o")).select("row", "o.*")
    found = open_.join(rest, ["x", "y"]).groupBy("row").agg(F.collect_list("places").alias("at"), F.collect_list("id").alias("found"))

    def fill(batches):
        for batch in batches:
            for ids, at, names in zip(batch.column(0), batch.column(1), batch.column(2)):
                own = np.frombuffer(ids.as_py(), kind).copy()
                if at.is_valid:
                    own[at.values.to_numpy()] = names.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["ids"])

    return table.select("row", "ids").join(found, "row", "left").select("ids", "at", "found").mapInArrow(fill, "ids binary")


def name_words(rows: DataFrame, words: DataFrame, most: int) -> Ids:
    """Rows of ids of frequent words in the order of the texts, -1 at rare ones and between pieces."""
    least, kind = _sent(words, most), _kind(words.count())
    sent = defaultdict(dict)
    for lang, word, i in words.where(F.col("f") >= least).select("lang", "word", "id").toLocalIterator():
        sent[lang][word.encode("utf-8")] = i
    rest = words.where(F.col("f") < least).select(F.col("lang").alias("x"), F.col("word").alias("y"), "id")
    all_sent = least <= 1 or rest.isEmpty()
    shared = rows.sparkSession.sparkContext.broadcast(dict(sent))

    def parts(batches):
        ids, places, x, y = [], [], [], []
        for part in common.slices(batches):
            for lang, raw in _raw(part):
                tokens = raw.translate(_PIECED).replace(b",", b" , ").split()
                start = len(ids)
                ids += map(shared.value.get(lang, {}).get, tokens, repeat(-1))
                ids.append(-1)
                if not all_sent:
                    for k, token in enumerate(tokens, start):
                        if ids[k] < 0 and token != b",":
                            places.append(k)
                            x.append(lang)
                            y.append(token.decode("utf-8"))
                if len(ids) >= ROW:
                    yield np.array(ids, kind), places, x, y
                    ids, places, x, y = [], [], [], []
        if ids:
            yield np.array(ids, kind), places, x, y

    if all_sent:
        named = rows.mapInArrow(lambda batches: _rows(parts(batches)), "row long, ids binary")
        return Ids(common.materialize(named.select("ids"), "word-ids"), kind)
    named = common.materialize(rows.mapInArrow(lambda batches: _rows(parts(batches), pa.string()), "row long, ids binary, places array<long>, x array<string>, y array<string>"), "word-ids-open")
    return Ids(common.materialize(_joined(named, rest, kind), "word-ids"), kind)


def _pairs(batches, kind: str):
    common.kept("")
    common.release()
    for batch in batches:
        for ids in batch.column(0):
            own = np.frombuffer(ids.as_buffer(), kind).astype(np.int64)
            yield own, np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))


def count_pairs(ids: Ids) -> DataFrame:
    """a, b and f of all neighbouring ids."""
    kind = ids.kind

    def run(batches):
        held, size = [], 0

        def out():
            pairs = np.concatenate(held, 1)
            order = np.lexsort(pairs[::-1])
            pairs = pairs[:, order]
            new = np.ones(pairs.shape[1], bool)
            new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
            at = np.flatnonzero(new)
            f = np.diff(np.append(at, pairs.shape[1]))
            return pa.RecordBatch.from_arrays([pa.array(pairs[0, at]), pa.array(pairs[1, at]), pa.array(f)], ["a", "b", "f"])

        for own, at in _pairs(batches, kind):
            held.append(np.stack([own[at], own[at + 1]]))
            size += len(at)
            if size > HELD_PAIRS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return ids.table.mapInArrow(run, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f"))


def name_pairs(ids: Ids, pairs: DataFrame, most: int, tag: str) -> Ids:
    """Rows of ids of frequent pairs at the place of the first, -1 elsewhere."""
    least, kind, before = _sent(pairs, most), _kind(pairs.count()), ids.kind
    sent = pairs.where(F.col("f") >= least).select("a", "b", "id").toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    rest = pairs.where(F.col("f") < least).select(F.col("a").alias("x"), F.col("b").alias("y"), "id")
    all_sent = least <= 1 or rest.isEmpty()
    shared = pairs.sparkSession.sparkContext.broadcast([sent.column(c).to_numpy() for c in ("a", "b", "id")])

    def parts(batches):
        a, b, names = shared.value
        lefts = np.unique(a)  # pairs as numbers: place of the left id among all, and the right one
        top = int(b.max()) + 1 if len(b) else 1
        known = np.searchsorted(lefts, a) * top + b
        for own, at in _pairs(batches, before):
            x, y, found = own[at], own[at + 1], np.full(max(len(own) - 1, 0), -1, kind)
            if len(known):
                left = np.minimum(np.searchsorted(lefts, x), len(lefts) - 1)
                key = left * top + y
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = (known[place] == key) & (lefts[left] == x) & (y < top)
                found[at[hit]] = names[place[hit]]
                at, x, y = at[~hit], x[~hit], y[~hit]
            yield found, at, x, y

    if all_sent:
        named = ids.table.mapInArrow(lambda batches: _rows(parts(batches)), "row long, ids binary")
        return Ids(common.materialize(named.select("ids"), tag), kind)
    named = common.materialize(ids.table.mapInArrow(lambda batches: _rows(parts(batches), pa.int64()), "row long, ids binary, places array<long>, x array<long>, y array<long>"), f"{tag}-open")
    return Ids(common.materialize(_joined(named, rest, kind), tag), kind)


def _phrases(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """pairs with their language, words, and counts of their first and of their last 1, 2 ... words, from their parents."""
    left = shorter.select(F.col("id").alias("a"), "lang", "phrase", "heads")
    right = shorter.select(F.col("id").alias("b"), "last", "tails")
    both = pairs.join(left, "a").join(right, "b")
    longer = lambda counts: F.concat(counts, F.array("f"))
    return both.select("id", "a", "b", "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", longer("heads").alias("heads"), longer("tails").alias("tails"))


def _scored(phrases: DataFrame, words: int) -> DataFrame:
    """phrases with l, r and score of the lowest-scoring cut, of equal ones the first."""
    cuts = [f"struct((cast(f as decimal(20, 0)) * 2000000) div cast(heads[{k - 1}] + tails[{words - k - 1}] as decimal(20, 0)) as score, {k} as k, heads[{k - 1}] as l, tails[{words - k - 1}] as r)" for k in range(1, words)]
    return phrases.withColumn("cut", F.expr(f"array_min(array({', '.join(cuts)}))")).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def mine_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, percent: int = PERCENT, most_named: int = MOST_NAMED, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n and score of all phrases of 2 to ``most_words`` words that no longer one swallows."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[f"`{lang}`"], F.lit("und")).alias("lang"), docs[f"`{text}`"].alias("text"))
    with common.scratch(spark):
        counted = common.materialize(count_words(rows), "word-counts")
        totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        words = with_ids(counted.where(F.col("f") >= least), "words")
        table = name_words(rows, words, most_named)
        level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
        kept = []
        for k in range(2, most_words + 1):
            pairs = with_ids(count_pairs(table).where(F.col("f") >= least), f"phrases-{k}")
            above = pairs.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            if k > 2:
                kept[-1] = kept[-1].join(above, "id", "left").where("longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * " + str(int(percent))).drop("longer")
            level = common.materialize(_phrases(pairs, level), f"level-{k}")
            kept.append(_scored(level, k))
            if k < most_words:
                table = name_pairs(table, pairs, most_named, f"ids-{k}")
        found = kept[0]
        for other in kept[1:]:
            found = found.unionByName(other)
        return common.materialize(found.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score"), "phrases", keep=True)


def best_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, with their rank: chosen within groups first, so that none takes all of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    chosen = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    chosen = chosen.drop("salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return chosen.where(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine_phrases(common.read_table(spark, sf_dir, "documents"))
    return best_phrases(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), gram AS (
  SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM piece CROSS JOIN range(1, 5) t(k) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30
), inside AS (
  SELECT lang, array_to_string(w, ' ') AS phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2), lambda i: w[i : i + j - 1])))) AS w FROM candidate)
  GROUP BY ALL
), parts AS (
  SELECT *, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)
), cut AS (
  SELECT c.lang, c.phrase, j, c.f, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM parts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT b.lang, b.phrase, b.f AS a, l, r, n, b.score::BIGINT AS score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.f DESC, b.phrase) AS rank
  FROM lowest b JOIN total USING (lang) LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.phrase IS NULL OR 100 * i.longer < 80 * b.f
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
