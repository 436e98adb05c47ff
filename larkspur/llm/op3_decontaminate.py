"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts and items are lower-cased (A-Z) and cut into words.  The automaton takes in all items; a document's words run
through it and give, at each word, the longest match that ends there.  Where that is at least a window long, the window's
words are hit and the items that hold the window are known from the state; items shorter than a window count when they
match whole.  Words that no item holds break every match, so only runs of known words walk the automaton.

Items are data of unknown size: the distinct ones, long ones cut into pieces that share a window less a word, are dealt into blocks of
a bounded number of words, an automaton each, and one block after another is sent to the executors and run over all documents.

Defined results: a null or empty text has no words and no hits; an item without words is ignored, one that is there several times counts
once; the longest match ends where a piece of an item does; repeated rows give a row each;
an empty table on either side gives no hits; other columns pass through ``decontaminate`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Words of a window.
WINDOW = 10
#: Item words that one automaton takes in; about 100 MB in a worker.
BLOCK_WORDS = 500_000
#: A document of which more than this share is hit goes as a whole; of others the hit spans go.
MAX_COVERAGE = 0.8
#: Hit spans of fewer words than this stay; a window is the shortest there is, unless an item is shorter.
MIN_SPAN = 1

#: Bytes that words are made of after lower-casing (digits, a-z, all of other scripts) as they are, all others as a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")



def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that each window and each short item belongs to.

    Words are numbers here, and states lie in plain arrays: nearly all have one follower, which is kept beside them; the followers of
    others, as far as there are more, are in ``more``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        sequences = [array("i", [number(w) for w in words]) for _, words in items]
        for own in sequences:
            last = 0
            for w in own:
                last = self._extend(last, w)
        self.items = [item for item, _ in items]
        #: The item of a state that stands for a window; where there are several, -2 - k for the k-th of ``shared``.
        self.owner = array("i", [-1]) * len(self.link)
        self.shared: list[tuple[int, ...]] = []
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for item, own in enumerate(sequences):
            state = 0
            for k, w in enumerate(own, 1):
                state = self.step(state, w)
                if k >= window:
                    self._own(self._at_window(state), item)
            if 0 < len(own) < window:
                self.shorts.setdefault(state, []).append((len(own), item))
        self.least = min((min(len(own), window) for own in sequences if own), default=window)

    def step(self, state: int, w: int) -> int:
        """The state that follows by a word, or -1."""
        if self.word[state] == w:
            return self.to[state]
        others = self.more.get(state)
        return others.get(w, -1) if others else -1

    def _put(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _own(self, state: int, item: int) -> None:
        held = self.owner[state]
        if held == -1:
            self.owner[state] = item
        elif held <= -2:
            if item not in self.shared[-2 - held]:
                self.shared[-2 - held] += (item,)
        elif held != item:
            self.shared.append((held, item))
            self.owner[state] = -1 - len(self.shared)

    def owners(self, state: int) -> tuple[int, ...]:
        held = self.owner[state]
        return self.shared[-2 - held] if held <= -2 else () if held == -1 else (held,)

    def _extend(self, last: int, w: int) -> int:
        there = self.step(last, w)
        if there >= 0:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, w, there)
        new = self._state(-1, self.length[last] + 1)
        p = last
        while p >= 0 and (there := self.step(p, w)) < 0:
            self._put(p, w, new)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            self.link[new] = there if self.length[there] == self.length[p] + 1 else self._clone(p, w, there)
        return new

    def _state(self, link: int, length: int) -> int:
        for values, x in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            values.append(x)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, there: int) -> int:
        copy = self._state(self.link[there], self.length[p] + 1)
        self.word[copy], self.to[copy] = self.word[there], self.to[there]
        if there in self.more:
            self.more[copy] = dict(self.more[there])
        self.link[there] = copy
        while p >= 0 and self.step(p, w) == there:
            self._put(p, w, copy)
            p = self.link[p]
        return copy

    def _at_window(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans [start, end) in words, items found, and the longest match."""
        numbers = list(map(self.vocabulary.get, words))
        known = bytes([w is not None for w in numbers])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state = size = 0
            for at in range(run.start(), run.end()):
                w = numbers[at]
                to = self.step(state, w)
                while state and to < 0:
                    state = self.link[state]
                    size = self.length[state]
                    to = self.step(state, w)
                if to >= 0:
                    state, size = to, size + 1
                longest = max(longest, size)
                found = 0
                if size >= self.window:
                    found = self.window
                    items.update(self.owners(self._at_window(state)))
                if self.shorts:
                    up = state
                    while up > 0:
                        for n, item in self.shorts.get(up, ()):
                            if n <= size:
                                found = max(found, n)
                                items.add(item)
                        up = self.link[up]
                if found:
                    begin = at + 1 - found
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, {self.items[k] for k in items}, longest


def _automaton(block) -> Automaton:
    """The automaton of a broadcast block (key, items, window), built once a worker; only the last block is kept."""
    key, items, window = block.value
    built = common.kept("decontaminate")
    if key not in built:
        built.clear()
        built[key] = Automaton([(k, words_of(text)) for k, text in items], window)
        common.release()
    return built[key]


def item_pieces(benchmark: DataFrame, window: int, block_words: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """id, n (words) and text of the distinct items, cut into pieces of a sixteenth of ``block_words``, so that blocks are about equal.

    A piece begins with the last window - 1 words of the one before, so that each window of an item lies whole in a piece.
    """
    step = max(window, block_words // 16)

    def cut(batches):
        for batch in batches:
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(own)
                pieces = [words[a : a + step + window - 1] for a in range(0, max(1, len(words) - window + 1), step)]
                columns = [[item] * len(pieces), [len(w) for w in pieces], [b" ".join(w).decode("utf-8") for w in pieces]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["id", "n", "text"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    return rows.mapInArrow(cut, "id string, n long, text string").where("n > 0").distinct()


def item_blocks(benchmark: DataFrame, window: int, block_words: int, item_id: str = "item_id", text: str = "text"):
    """Yield broadcast blocks of items or pieces of them, each of about ``block_words`` words; one is on the driver at a time."""
    spark = benchmark.sparkSession
    pieces = item_pieces(benchmark, window, block_words, item_id, text)
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words)
    for k in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else pieces
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.id, r.text) for r in rows.select("id", "text").collect()], window))


_FOUND = "doc_id long, row_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest int"


def _matches(rows: DataFrame, block) -> DataFrame:
    def run(batches):
        automaton = _automaton(block) if block is not None else Automaton([], WINDOW)
        for part in common.slices(batches, owner="decontaminate"):
            found = {name: [] for name in ("n_words", "spans", "items", "longest")}
            for text in part.column(1).to_pylist():
                words = words_of(text)
                spans, items, longest = automaton.match(words)
                found["n_words"].append(len(words))
                found["spans"].append([{"start": a, "end": b} for a, b in spans])
                found["items"].append(sorted(items))
                found["longest"].append(longest)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.int32())
            columns = [pa.array(v, kind) for v, kind in zip(found.values(), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "row_hash", *found])

    return rows.mapInArrow(run, _FOUND)


def _merged(spans):
    """Overlapping spans of several blocks as one, in order."""
    step = lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, row_hash (of the text), n_words, hit spans in words, ids of items found, longest match in words.

    With one block of items this is a single pass without a shuffle.  With more, the hits of each block (documents that
    have any) go to the shared folder, and those of a document meet in one group-by.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("row_hash"))
    blocks = item_blocks(benchmark, window, block_words)
    first = next(blocks, None)
    found = _matches(rows, first)
    hits, n_blocks = None, 1
    for block in blocks:
        n_blocks += 1
        if hits is None:
            hits = common.materialize(found.where(F.size("spans") > 0).distinct(), "item-hits")
        hits = hits.unionByName(common.materialize(_matches(rows, block).where(F.size("spans") > 0).distinct(), "item-hits"))
        block.unpersist()
    if n_blocks == 1:
        return found
    hits = hits.groupBy(F.col("doc_id").alias("h_id"), F.col("row_hash").alias("h_row")).agg(
        F.flatten(F.collect_list("spans")).alias("h_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("h_items"), F.max("longest").alias("h_longest")
    )
    n_words = _matches(rows, None).select("doc_id", "row_hash", "n_words")
    joined = n_words.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row_hash") == F.col("h_row")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select("doc_id", "row_hash", "n_words", _merged(F.coalesce("h_spans", none)).alias("spans"), F.coalesce("h_items", F.array().cast("array<string>")).alias("items"), F.coalesce("h_longest", F.lit(0)).alias("longest"))


def remove_spans(text: str, automaton: Automaton, max_coverage: float, min_span: int) -> str | None:
    """The text without its hit spans, again until none is left; None if too much of it is hit."""
    while True:
        raw = text.encode("utf-8")
        flat = raw.translate(_WORD_BYTES)
        words = flat.split()
        spans = [s for s in automaton.match(words)[0] if s[1] - s[0] >= min_span]
        if not spans:
            return text
        if sum(b - a for a, b in spans) > max_coverage * len(words):
            return None
        text = _without(raw, flat, spans)


def _without(raw: bytes, flat: bytes, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in _WORD.finditer(flat)]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : places[a][0]])
        end = places[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, min_span: int = MIN_SPAN, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """docs with all its columns and without hit spans; rows of which more than max_coverage is hit are gone.

    Rows without a hit come back byte for byte.  With one block of items this is one pass over the text without a shuffle; with
    more, all blocks are run over the rows before anything is removed, so that the result is the same for any block size.
    """
    blocks = item_blocks(benchmark, window, block_words)
    block, more = next(blocks, None), next(blocks, None)
    if more is not None:
        block.unpersist()
        more.unpersist()
        return _clean_by_blocks(docs, benchmark, window, max_coverage, min_span, block_words, text)
    if block is None:
        return docs
    # the other columns ride along under names of our own
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        automaton = _automaton(block)
        for part in common.slices(batches, owner="decontaminate"):
            own = part.column(1).to_pylist()
            clean = [None if t is None else remove_spans(t, automaton, max_coverage, min_span) for t in own]
            keep = pa.array([c is not None or t is None for c, t in zip(clean, own)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, part.schema.field(1).type)], schema=part.schema).filter(keep)

    place = {c: k for k, c in enumerate(rest)}
    return rows.mapInArrow(run, rows.schema).select(*(F.col("text" if c == text else f"row.c{place[c]}").alias(c) for c in docs.columns))


def _clean_by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float, min_span: int, block_words: int, text: str) -> DataFrame:
    """In rounds: the merged spans of all blocks in the rows still open; rows without one are done, the others lose theirs or go."""

    def cut(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = t.encode("utf-8")
                flat = raw.translate(_WORD_BYTES)
                spans = [(s["start"], s["end"]) for s in spans]
                out.append(None if sum(b - a for a, b in spans) > max_coverage * len(flat.split()) else _without(raw, flat, spans))
            kept = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], ["row", "text"])
            yield kept.filter(pa.array([t is not None for t in out]))

    still, done = docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), []
    while True:
        # equal texts have equal hits, so a text's two hashes stand for it
        keyed = still.withColumn("one", F.xxhash64("text", F.lit(1))).withColumn("two", F.xxhash64("text"))
        found = match_items(keyed.select("one", "text"), benchmark, window, block_words, "one")
        spans = F.filter("spans", lambda s: s["end"] - s["start"] >= min_span)
        found = found.select(F.col("doc_id").alias("one"), F.col("row_hash").alias("two"), spans.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["one", "two"])
        met = common.materialize(keyed.join(found, ["one", "two"], "left").select("row", "text", "spans"), "met")
        done.append(met.where("spans is null").select("row", "text"))
        hit = met.where("spans is not null")
        if not hit.limit(1).count():
            break
        still = common.materialize(hit.mapInArrow(cut, still.schema), "cleaned")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(F.col("text" if c == text else f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_items(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark)
  WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
