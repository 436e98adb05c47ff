"""LM scoring by prediction by partial matching over bytes.

The model is a byte-context trie of up to three bytes: for each context the bytes that followed it in the training
texts and how often.  A byte is coded in the longest context of the trie; one that never followed there costs an escape
(estimated as distinct followers over occurrences plus distinct followers) and is coded in the next shorter context, with
the symbols of the longer one excluded.  Below the empty context all bytes not yet excluded are equally likely.  A text
starts after three bytes that no text holds and ends with an end symbol, so that scores are log10 probabilities.

The same pass counts the words of a plain add-one unigram model (the base score).

How it scales: every task counts words and byte contexts of its own texts and only the counts are shuffled.  What is
broadcast has a bound: all contexts of up to two bytes (65,536 at most), the ``CONTEXTS`` most frequent ones of three bytes and
``COMMON_WORDS`` words; all other contexts and words are joined by key, exactly, and each of them is rare by construction, so no
key is hot.  Scores do not depend on the bounds.

Defined results: null and empty texts are the end token alone; rows of equal id and text share their values, a row each;
without training rows the words have no counts and all bytes are equally likely; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

#: Contexts of three bytes, the most frequent ones, that are broadcast at most.
CONTEXTS = 32_768
#: Words, the most frequent ones, whose counts are broadcast at most.
COMMON_WORDS = 200_000
#: Distinct keys that a counting task holds before it hands them on.
HELD = 600_000
#: Bytes that UTF-8 never has: before the text, and its end.
START, END = 0xFE, 0xFF
WORD, GRAM = 0, 1


def symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text with three START before it and an END after it, end to end."""
    n = len(at) - 1
    out = np.full(len(data) + 4 * n, START, np.uint8)
    out[np.arange(len(data)) + np.repeat(4 * np.arange(n) + 3, np.diff(at))] = data
    out[at[1:] + 4 * np.arange(1, n + 1) - 1] = END
    return out


def grams(out: np.ndarray) -> np.ndarray:
    """Three bytes of context and the byte after them as one integer, for all bytes but START."""
    wide = out.astype(np.uint32)
    code = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    return code[out[3:] != START]


class Tally:
    """Sums by key, with two values a key; ``due`` once it holds too many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray, m: np.ndarray) -> None:
        self.parts.append((key, n, m))
        self.size += len(key)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        key, n, m = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.parts = [(key[first], np.add.reduceat(n[order], first), np.add.reduceat(m[order], first))]
        self.size = len(first)

    def take(self, kind: int) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self.merge()
        key, n, m = self.parts[0]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(common.signed(key)), pa.array(n), pa.array(m)], ["kind", "key", "n", "m"])


def _rows(docs: DataFrame, train, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.xxhash64(text).alias("row_hash"))


def count_corpus(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """kind, key, n, m: for words the occurrences in all rows and in training rows, for byte grams those in training rows (both)."""

    def run(batches):
        word, gram = Tally(), Tally()
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(1))
            data = common.LOWER[data]
            train = part.column(2).to_numpy(zero_copy_only=False)
            words = common.Words(data, at)
            order = np.argsort(words.hash)
            ranked = words.hash[order]
            if len(ranked):
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                own = train[words.text_of()][order].astype(np.int64)
                word.add(ranked[first], np.diff(np.append(first, len(ranked))), np.add.reduceat(own, first))
            if train.any():
                size = np.diff(at)
                kept = np.repeat(train, size)
                code, n = np.unique(grams(symbols(data[kept], np.concatenate([[0], np.cumsum(size[train])]))), return_counts=True)
                gram.add(code.astype(np.uint64), n, n)
            for kind, tally in ((WORD, word), (GRAM, gram)):
                if tally.size > HELD and (batch := tally.take(kind)) is not None:
                    yield batch
        for kind, tally in ((WORD, word), (GRAM, gram)):
            if (batch := tally.take(kind)) is not None:
                yield batch

    counts = _rows(docs, train, doc_id, text).mapInArrow(run, "kind int, key long, n long, m long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def heaviest(rows: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """The rows whose n is at least a threshold, which is the least one that lets at most ``bound`` rows through; and it.

    One small group-by over classes of n, so nothing is sorted and no row is collected to find the threshold.
    """
    least = F.when(F.col("n") < 64, F.col("n")).otherwise(F.ceil(F.pow(F.lit(1.05), F.floor(F.log(1.05, F.col("n").cast("double"))))).cast("long"))
    classes = sorted(rows.groupBy(least.alias("least")).count().collect(), reverse=True)
    total, threshold = 0, None
    for c in classes:
        total += c["count"]
        if total > bound:
            break
        threshold = c.least
    if total <= bound:
        return rows, 0
    threshold = classes[0].least + 1 if threshold is None else threshold
    return rows.where(F.col("n") >= threshold), threshold


class Model:
    """log10 probabilities of all bytes in each context of the trie."""

    def __init__(self, zero: np.ndarray, one: np.ndarray, two: tuple, three: tuple, partial: bool = False):
        """Counts of 256 followers: of the empty context, of each byte (256 x 256), and keys and counts of the longer ones.

        partial: whether there are contexts of three bytes beside those given, which ``gains`` is to be asked for.
        """
        keys2, counts2 = two
        keys3, counts3 = three
        under0 = np.where(zero > 0, 0, 1.0 / max(1, 256 - (zero > 0).sum()))[None]
        p0 = self._mixed(zero[None], under0)
        under1 = self._under(one, np.zeros(256, int), zero[None], under0)
        p1 = self._mixed(one, under1)
        p1[~one.any(1)] = p0[0]
        parent2 = (keys2 & 0xFF).astype(int)
        under2 = self._under(counts2, parent2, one, under1)
        self.upper = (counts2, under2) if partial else None
        at2 = np.full(1 << 16, -1, np.int32)
        at2[keys2] = np.arange(len(keys2))
        parent3 = at2[keys3 & 0xFFFF]
        keys3, counts3, parent3 = keys3[parent3 >= 0], counts3[parent3 >= 0], parent3[parent3 >= 0]
        under3 = self._under(counts3, parent3, counts2, under2)
        with np.errstate(divide="ignore"):
            self.table = np.log10(np.concatenate([p1, self._mixed(counts2, under2), self._mixed(counts3, under3)])).astype(np.float32).ravel()
        self.row2 = np.where(at2 >= 0, at2 + 256, np.arange(1 << 16) & 0xFF).astype(np.int32)
        self.slot = at2
        self.row3 = np.full(max(1, len(keys2)) * 256, -1, np.int32)
        self.row3[parent3 * 256 + (keys3 >> 16)] = 256 + len(keys2) + np.arange(len(keys3))

    @staticmethod
    def _mixed(counts: np.ndarray, under: np.ndarray) -> np.ndarray:
        """Probabilities of all bytes: seen ones by count, the others through an escape."""
        n, t = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        total = np.maximum(n + t, 1)
        return np.where(counts > 0, counts / total, np.where(n > 0, t / total, 1.0) * under)

    @staticmethod
    def _under(counts: np.ndarray, parent: np.ndarray, up: np.ndarray, up_under: np.ndarray) -> np.ndarray:
        """Probabilities of bytes unseen in each context, after the escape: from its parent without what was seen."""
        out = np.empty((len(counts), 256), np.float32)
        for a in range(0, len(counts), 4096):
            seen = counts[a : a + 4096] > 0
            rest = np.where(seen, 0, up[parent[a : a + 4096]])
            n, t = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
            total = np.maximum(n + t, 1)
            out[a : a + 4096] = np.where(rest > 0, rest / total, np.where(t > 0, t / total, 1.0) * up_under[parent[a : a + 4096]])
        return out

    def score(self, out: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of ``symbols`` but START, in order."""
        wide = out.astype(np.int32)
        two = (wide[1:-2] << 8) | wide[2:-1]
        row = self.row2[two]
        slot = self.slot[two]
        longer = self.row3[np.maximum(slot, 0) * 256 + wide[:-3]]
        row = np.where((slot >= 0) & (longer >= 0), longer, row)
        return self.table[row * 256 + wide[3:]][out[3:] != START]

    def unheld(self, code: np.ndarray) -> np.ndarray:
        """Whether the three bytes before each of these grams are a context that the table lacks."""
        slot = self.slot[(code >> 8) & 0xFFFF]
        return (slot >= 0) & (self.row3[np.maximum(slot, 0) * 256 + (code >> 24)] < 0)

    def gains(self, context: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What log10 probabilities of all bytes gain over those of ``score``, in contexts that the table lacks, from their followers."""
        parent = self.slot[context & 0xFFFF]
        mixed = self._mixed(counts, self._under(counts, parent, *self.upper))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log10(mixed) - self.table.reshape(-1, 256)[parent + 256]


def _cells(rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted context keys and their counts of followers, from rows of (context << 8 | byte, n)."""
    table = rows.toArrow()
    code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    keys, place = np.unique(code >> 8, return_inverse=True)
    counts = np.zeros((len(keys), 256), np.float32 if width > 1 else np.float64)
    counts[place, code & 0xFF] = n
    return keys, counts


def fit(counts: DataFrame, contexts: int | None = None, held: int = CONTEXTS) -> Model:
    """The model of the byte grams in ``counts``; see ``fit_all``."""
    return fit_all(counts, contexts, held)[0]


def fit_all(counts: DataFrame, contexts: int | None = None, held: int = CONTEXTS) -> tuple[Model, DataFrame | None]:
    """The model, and code and n of the grams of contexts that it lacks; None if it has all.

    What reaches the driver has a bound: ``held`` x 256 cells of the longest order, 65,536 x 256 of the one below.  With
    ``contexts``, the trie itself is cut to so many contexts of each of the two longer orders.
    """
    gram = counts.where(F.col("kind") == GRAM)

    def cells(bits: int, bound: int):
        code = gram.groupBy((F.col("key").bitwiseAND((1 << bits) - 1)).alias("code")).agg(F.sum("n").alias("n"))
        totals = code.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("n"))
        chosen, threshold = heaviest(totals, bound)
        rest = None
        if threshold:
            own = lambda these: code.join(these.select("context"), F.shiftright("code", 8) == F.col("context"), "left_semi")
            code, rest = own(chosen), own(totals.where(F.col("n") < threshold))
        return _cells(code, bits // 8), rest

    keys1, counts1 = cells(16, 256)[0]
    one = np.zeros((256, 256))
    one[keys1] = counts1
    two = cells(24, contexts or 1 << 16)[0]
    three, rest = cells(32, contexts or held)
    rest = None if contexts else rest
    return Model(one.sum(0), one, two, three, rest is not None), rest


def _gains(rest: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """code, gain: of the grams ``wanted`` those in a context of ``rest``."""

    def run(batches):
        model = shared.value[0]
        for batch in batches:
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                context = part.column(0).to_numpy()
                size = lambda k: np.repeat(np.arange(part.num_rows), part.column(k).value_lengths().to_numpy())
                counts = np.zeros((part.num_rows, 256), np.float32)
                counts[size(1), part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                own, byte = size(3), part.column(3).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(context[own] << 8 | byte), pa.array(model.gains(context, counts)[own, byte].astype(np.float64))], ["code", "gain"])

    context, byte = F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(0xFF).alias("byte")
    # of a context there are at most 256 of either
    followers = rest.select(context, F.struct(byte, "n").alias("f")).groupBy("context").agg(F.collect_list("f").alias("f"))
    asked = wanted.distinct().select(context, byte).groupBy("context").agg(F.collect_list("byte").alias("asked"))
    return followers.join(asked, "context").select("context", F.col("f.byte").alias("bytes"), F.col("f.n").alias("n"), "asked").mapInArrow(run, "code long, gain double")


def score_documents(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", contexts: int | None = None, common_words: int = COMMON_WORDS, held: int = CONTEXTS) -> DataFrame:
    """Learn from rows where ``train`` holds and score all rows.

    Gives doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability of the
    text under the byte model), n_symbols (bytes and the end) and bits_per_symbol.
    """
    spark = docs.sparkSession
    counts = common.materialize(count_corpus(docs, train, doc_id, text), "corpus-counts")
    word = counts.where(F.col("kind") == WORD)
    n_docs = counts.where((F.col("kind") == GRAM) & (F.col("key").bitwiseAND(0xFF) == END)).agg(F.sum("n")).first()[0] or 0
    n_words, distinct = word.agg(F.sum("m"), F.count_if(F.col("m") > 0)).first()
    train_tokens, vocabulary = (n_words or 0) + n_docs, distinct + (n_docs > 0)
    frequent, threshold = heaviest(word, common_words)
    known = frequent.select("key", "m").toArrow()
    key = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    model, rest = fit_all(counts, contexts, held)
    shared = spark.sparkContext.broadcast((model, key[order], known.column("m").to_numpy()[order]))
    names = ("doc_id", "row_hash", "train", "n_tokens", "n_known", "base", "score", "n_symbols", "words", "times", "codes", "code_times")

    def run(batches):
        model, keys, in_train = shared.value
        gain = np.log10(in_train + 1.0)
        for part in common.slices(batches):
            data, at = common.text_bytes(part.column(1))
            data = common.LOWER[data]
            n = part.num_rows
            words = common.Words(data, at)
            text = words.text_of()
            place = np.minimum(np.searchsorted(keys, words.hash), max(len(keys) - 1, 0))
            frequent = keys[place] == words.hash if len(keys) else np.zeros(len(text), bool)
            place = place[frequent]
            base = np.bincount(text[frequent], gain[place], n) if len(keys) else np.zeros(n)
            known = np.bincount(text[frequent], in_train[place] > 0, n).astype(np.int64) if len(keys) else np.zeros(n, np.int64)
            rare, own = words.hash[~frequent], text[~frequent]
            order = np.lexsort((rare, own))
            rare, own = rare[order], own[order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=n))]), pa.int32())
            size = np.diff(at) + 1
            out = symbols(data, at)
            total = np.add.reduceat(model.score(out).astype(np.float64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            columns = [part.column(0), part.column(3), part.column(2), pa.array(words.counts + 1), pa.array(known), pa.array(base), pa.array(total), pa.array(size)]
            columns += [pa.ListArray.from_arrays(lists, pa.array(common.signed(rare[first]))), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(first, len(rare)))))]
            code, text = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if model.upper is not None:
                code = grams(out).astype(np.int64)
                lacks = model.unheld(code)
                code, text = code[lacks], np.repeat(np.arange(n), size)[lacks]
            # grams of a text are together, so that one sort by both counts them
            both, times = np.unique(text << 32 | code, return_counts=True)
            lists = pa.array(np.searchsorted(both >> 32, np.arange(n + 1)), pa.int32())
            columns += [pa.ListArray.from_arrays(lists, pa.array(both & 0xFFFFFFFF)), pa.ListArray.from_arrays(lists, pa.array(times))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, row_hash long, train boolean, n_tokens long, n_known long, base double, score double, n_symbols long, words array<long>, times array<long>, codes array<long>, code_times array<long>"
    scored = common.materialize(_rows(docs, train, doc_id, text).mapInArrow(run, schema), "scored")
    rare = word.where((F.col("m") > 0) & (F.col("n") < threshold)).select("key", "m")
    at = F.explode(F.arrays_zip("words", "times")).alias("at")
    found = scored.select("doc_id", "row_hash", at).select("doc_id", "row_hash", F.col("at.words").alias("key"), F.col("at.times").alias("times")).join(rare, "key")
    lists = ("words", "times", "codes", "code_times")
    nothing = {c: F.lit(None).cast(t) for c, t in scored.dtypes if c not in ("doc_id", "row_hash", *lists)}
    added = {"more": F.lit(0.0), "more_known": F.lit(0).cast("long"), "more_score": F.lit(0.0), "rows": F.lit(0)}

    def line(df: DataFrame, own: dict, **more) -> DataFrame:
        return df.select("doc_id", "row_hash", *(v.alias(c) for c, v in (own | added | more).items()))

    both = line(scored, {c: F.col(c) for c in nothing}, rows=F.lit(1)).unionByName(line(found, nothing, more=F.col("times") * F.log10(F.col("m") + 1.0), more_known=F.col("times")))
    if rest is not None:
        at = F.explode(F.arrays_zip("codes", "code_times")).alias("at")
        code = scored.select("doc_id", "row_hash", at).select("doc_id", "row_hash", F.col("at.codes").alias("code"), F.col("at.code_times").alias("times"))
        gains = common.materialize(_gains(rest, code.select("code"), shared), "gains")
        both = both.unionByName(line(code.join(gains, "code"), nothing, more_score=F.col("times") * F.col("gain")))
    both = both.groupBy("doc_id", "row_hash").agg(*(F.max(c).alias(c) for c in nothing), *(F.sum(c).alias(c) for c in ("more", "more_known", "more_score")), F.sum("rows").cast("int").alias("rows"))
    both = both.withColumn("score", F.col("score") + F.col("more_score") / F.col("rows"))
    end = float(np.log10(n_docs + 1.0))
    scale = float(np.log10(train_tokens + vocabulary + 1.0))
    # rows of equal id and text have each added their words
    return both.select("*", F.explode(F.sequence(F.lit(1), "rows"))).select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_known") + (F.col("more_known") / F.col("rows")).cast("long") + int(n_docs > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") / F.col("rows") + end - F.col("n_tokens") * scale).alias("base_score"),
        "score",
        "n_symbols",
        (-F.col("score") / F.col("n_symbols") / F.lit(float(np.log10(2)))).alias("bits_per_symbol"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, common.bucket(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_symbols", "bits_per_symbol")
