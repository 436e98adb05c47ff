"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q that is at least ``LEAST`` words and ``TIMES`` * q long and that no
neighbouring word extends.  For each period p the grid asks how far the words from jp on and those from (j + 1)p on agree, forward and
backward; a run of period p is longer than two steps of its grid, so that some pair of neighbours lies in it and their two extensions
reach its ends.  Extensions are range minima over the LCP array of a suffix array, backward ones over that of the reversed words.
A period that is a multiple of the smallest one finds the same stretch, of which the smallest period stays.

How it scales: one pass over the texts, no shuffle; texts are taken in slices of about 1 MB, and the texts of a slice share one
suffix array in which words of different texts are different.  Texts none of whose windows of 16 words stands twice in them (by
hash, so that none with a run is passed over) can hold no run and build none.  The grid has n ln n queries for n words, asked
``QUERIES`` at a time; arrays take about 200 bytes a word of a text with repeated windows, the only thing that grows with
the length of one text.

Defined results: words are runs of characters other than \\x20 and \\x09-\\x0D; null, empty and wordless texts have no words and no
run, their collapsed text is empty; rows are treated each on its own, so repeated rows and null ids give equal rows; of runs only those
words go that stand after the first q words of any run; other columns pass through ``collapse``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
#: Pairs of positions that are compared at a time.
QUERIES = 1 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
WORD = r"[^\x20\x09-\x0D]+"


class Extensions:
    """Longest common extensions of two positions of a sequence: suffix array, LCP array, and a table of its range minima."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        spans, levels = [], []
        while rank.max() < n - 1:  # ranks by the first 1, 2, 4 ... words, until no two are equal
            spans.append(1 << len(spans))
            levels.append(np.append(rank, -1).astype(np.int32))
            after = np.zeros(n, np.int64)
            after[: n - spans[-1]] = rank[spans[-1] :] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        self.rank = rank.astype(np.int32)
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        common_prefix = np.zeros(n - 1, np.int64)
        while levels:
            span, level = spans.pop(), levels.pop()
            common_prefix += span * (level[suffixes[:-1] + common_prefix] == level[suffixes[1:] + common_prefix])
        least = common_prefix.astype(np.int32)
        self.minima = [least]
        step = 1
        while 2 * step <= n - 1:
            least = np.append(np.minimum(least[:-step], least[step:]), least[-step:])
            self.minima.append(least)
            step *= 2
        self.minima = np.stack(self.minima) if n > 1 else np.zeros((1, 1), np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree; i and j differ."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.minima[k, low], self.minima[k, high - (1 << k)])


def _grid(sizes: np.ndarray, starts: np.ndarray, times: int):
    """Positions jp and (j + 1)p of each text and each period that has room for a run, and p, some ``QUERIES`` at a time."""
    most = sizes // times
    first = np.cumsum(most) - most
    period = np.arange(most.sum()) - np.repeat(first, most) + 1
    start = np.repeat(starts, most)
    points = (np.repeat(sizes, most) - 1) // period
    ends = np.cumsum(points)
    done = 0
    while done < len(period):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + QUERIES, "right")))
        n, p = points[done:upto], period[done:upto]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        at = np.repeat(start[done:upto], n) + j * p
        yield at, at + p, p
        done = upto


def window_of(least: int, times: int) -> int:
    """Words that two places a period apart have in common at least, in the shortest runs."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def runs_of(words: common.Words, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Text, start, end and period of all runs, in order of text, start and period; places count from the text's first word."""
    none = (np.zeros(0, np.int64),) * 4
    value, first = words.shingles(window_of(least, times))
    text = words.text_of()
    with np.errstate(over="ignore"):
        own = common.mix(value + text[first].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(own, kind="stable")
    twice = own[order][1:] == own[order][:-1]
    chosen = np.zeros(len(words.counts), bool)
    chosen[text[first[order[1:][twice]]]] = True
    if not chosen.any():
        return none
    texts = np.flatnonzero(chosen)
    sizes = words.counts[texts]
    starts = np.cumsum(sizes) - sizes
    inside = chosen[text]
    code = np.unique(words.hash[inside], return_inverse=True)[1]
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.unique(owner * (int(code.max()) + 1) + code, return_inverse=True)[1]
    n = len(code)
    forward, backward = Extensions(code), Extensions(code[::-1])
    parts = []
    for i, j, p in _grid(sizes, starts, times):
        ahead = forward(i, j)
        behind = np.where(i > 0, backward(np.minimum(n - i, n - 1), n - j), 0)
        a, b = i - behind, j + ahead
        found = b - a >= np.maximum(least, times * p)
        parts.append(np.stack([a[found], b[found], p[found]]))
    a, b, p = np.concatenate(parts, 1)
    order = np.lexsort((p, b, a))
    a, b, p = a[order], b[order], p[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, p = a[new], b[new], p[new]
    owner = np.searchsorted(starts, a, "right") - 1
    order = np.lexsort((p, a))
    owner, a, b, p = owner[order], a[order], b[order], p[order]
    return texts[owner], a - starts[owner], b - starts[owner], p


def _scan(batches, least: int, times: int):
    """Adds n_words, runs and the collapsed text to batches of (row, text)."""
    for part in common.slices(batches):
        data, at = common.text_bytes(part.column(1))
        words = common.Words(data, at)
        text, a, b, p = runs_of(words, least, times)
        kept = np.ones(int(words.counts.sum()) + 1, np.int64)
        edge = np.zeros(len(kept), np.int64)
        base = words.first[text]
        np.add.at(edge, base + a + p, 1)
        np.add.at(edge, base + b, -1)
        kept = np.cumsum(edge) == 0
        raw, touched, collapsed = data.tobytes(), set(text.tolist()), []
        for k in range(part.num_rows):
            own = raw[at[k] : at[k + 1]].split()  # at the same six characters
            if k in touched:
                own = [w for w, keep in zip(own, kept[words.first[k] : words.first[k + 1]].tolist()) if keep]
            collapsed.append(b" ".join(own).decode("utf-8"))
        offsets = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b - a, p)], ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts.astype(np.int64)), runs.cast(RUNS), pa.array(collapsed, pa.string())], ["row", "n_words", "runs", "collapsed"])


def _scanned(rows: DataFrame, least: int, times: int) -> DataFrame:
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and a word")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _scan(batches, least, times), f"row {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length and period in words, by start, then period) and the collapsed text."""
    rows = docs.select(F.struct(F.col(doc_id).cast("long").alias("id")).alias("row"), F.col(text).alias("text"))
    return _scanned(rows, least, times).select(F.col("row.id").alias("doc_id"), "n_words", "runs", "collapsed")


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, text: str = "text") -> DataFrame:
    """docs with all columns; texts with a run get their kept words, joined by one space, all others stay as they are."""
    fields = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(f) for c, f in zip(docs.columns, fields))).alias("row"), docs[f"`{text}`"].alias("text"))
    own = fields[docs.columns.index(text)]
    short = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"row.{own}"))
    return _scanned(rows, least, times).select(*((short if f == own else F.col(f"row.{f}")).alias(c) for c, f in zip(docs.columns, fields)))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in one document of ten (by the crc32 of its id) with its words from some place on repeating the first of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    at = lambda i, n: F.when(i < g % n, i).otherwise(g % n + (i - g % n) % (F.lit(1) + F.floor((n - g % n) / (3 + g % 8)).cast("long")))
    # the array of words is a lambda's argument, so that it is made once and not once a word
    planted = lambda w: F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, at(i, F.size(w).cast("long")).cast("int"))), " ")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.element_at(F.transform(F.array(words), planted), 1)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start and period, so ties stay with the first
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x), y).otherwise(x))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Equal windows of 16 words at a distance q, in unbroken stretches, are the runs of period q.
ORACLE_SQL = r"""
WITH coded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) AS h
  FROM documents
), sized AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM coded
), shaped AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized
), word AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM shaped)
), listed AS (
  SELECT doc_id, list(w ORDER BY i) AS ws FROM word GROUP BY doc_id
), gram AS (
  SELECT doc_id, i, hash(ws[i + 1 : i + 16]) AS x FROM (SELECT doc_id, ws, unnest(range(len(ws) - 15)) AS i FROM listed)
), pair AS (
  SELECT s.doc_id, s.i, t.i - s.i AS q FROM gram s JOIN gram t ON s.doc_id = t.doc_id AND s.x = t.x AND t.i > s.i
), stretch AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair)
  GROUP BY doc_id, q, island
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(24, 3 * q) GROUP BY ALL
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id
), best AS (
  SELECT r.* FROM run r ANTI JOIN run s ON r.doc_id = s.doc_id AND (s.length * r.period > r.length * s.period OR s.length * r.period = r.length * s.period AND (s.start < r.start OR s.start = r.start AND s.period < r.period))
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
