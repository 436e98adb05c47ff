"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by encoding each of them with the library.  A text is
cut into pieces and pre-tokens; a pre-token that is such a string counts one, and only the rest is merged by the library.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as the library takes
them; null ids stay null; each row gives one row, repeated rows included; other columns of the input are not read.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, pieces

#: Tokens above which a document is over the limit.
LIMIT = 1024
#: The pre-token rule of byte-level BPE files.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Bytes of pieces that a worker remembers; most are whole tokens, cheap to count again.
REMEMBERED = 48 << 20


def whole_tokens(path: str) -> frozenset[str]:
    """The strings of the vocabulary that are one pre-token and that the library encodes alone as their own id."""
    tokenizer, of = pieces.load(path), pieces.byte_of_char()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    strings, ids = [], []
    for shown, i in vocabulary.items():
        try:
            s = bytes(of[c] for c in shown).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if s and (m := PRE_TOKEN.match(s)) and m.end() == len(s):
            strings.append(s)
            ids.append(i)
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, found) if e.ids == [i])


class PieceCounter:
    """Counts of pieces: whole tokens at once, other pre-tokens through the library, each distinct one once a batch."""

    def __init__(self, path: str, whole: frozenset[str], remembered: int = REMEMBERED):
        self.library, self.whole = pieces.Library(path), whole
        self.special = [t.content for t in self.library.tokenizer.get_added_tokens_decoder().values()]
        self.memo = pieces.Memo(self.count, remembered)

    def count(self, found: list[str]) -> list[int]:
        counts, rest, parts = [0] * len(found), {}, []
        together = "\n".join(found)
        special = [s for s in self.special if s in together]
        whole, tokens = self.whole, PRE_TOKEN.findall
        for k, piece in enumerate(found):
            if special and any(s in piece for s in special):
                parts.append((k, piece))
                rest[piece] = 0
            elif piece in whole:
                counts[k] = 1
            elif piece[1:].isalpha():  # mostly one pre-token; the library would cut it anyway
                parts.append((k, piece))
                rest[piece] = 0
            else:
                for token in tokens(piece):
                    if token in whole:
                        counts[k] += 1
                    else:
                        parts.append((k, token))
                        rest[token] = 0
        rest = dict(zip(rest, self.library.counts(list(rest))))
        for k, token in parts:
            counts[k] += rest[token]
        return counts

    def __call__(self, texts: list[str]) -> list[int]:
        return list(map(sum, self.memo.learn([pieces.split(t) for t in texts])))


def _counter(path: str, whole: frozenset[str] | None, remembered: int):
    """A function from texts to token counts, made once a worker."""
    counters = common.kept("token-counts")
    key = path, remembered
    if key not in counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            counters[key] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        elif whole is not None:
            counters[key] = PieceCounter(path, whole, remembered)
        else:
            plain = pieces.load(path)
            counters[key] = lambda texts: [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    return counters[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED, beside: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs, and as text its column ``beside``, if one is named; a worker
    remembers up to ``remembered`` bytes of pieces.

    A byte-level BPE .json file takes the shortcut; other files are counted by their library, text by text.  One pass
    without a shuffle.  The vocabulary that is sent to the executors is as large as the tokenizer's file, not the data.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(tokenizer) if pieces.cuts_at_spaces(tokenizer) else None)

    def run(batches):
        count = _counter(tokenizer, whole.value, remembered)
        for part in common.slices(batches, owner="token-counts"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            columns = [part.column(0), part.column(2), pa.array(count(texts), pa.int64()), *([part.column(3)] if beside else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "beside"][: len(columns)])

    other = [F.col(beside).cast("string").alias("beside")] if beside else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *other)
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long" + (", beside string" if beside else ""))
    found = counted.withColumn("over_limit", F.col("n_tokens") > limit)
    return found.withColumnRenamed("beside", beside) if beside else found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
