"""Best-fit packing of documents into training sequences of several permitted lengths.

A document of n tokens is cut into pieces of the largest length and a rest.  Pieces are taken by decreasing size; each goes
into the open bin that it fills best, whatever the bin's size.  Where none has room, a bin is opened of the permitted length
that costs least a token: each length that holds the piece is filled, for a trial, with the largest of the pieces still to come
that fit, and priced at the length that those contents would be downsized to.  Packings that open bins of at least one
preferred length throughout are tried too, each bin is at last downsized to the smallest permitted length that holds its
contents, and the packing that costs least is taken.

Documents are dealt evenly over shards of about ``SHARD_ROWS`` rows, a task each, so that a task's work and memory do not grow
with the input; at most the last bins of a shard are less full than they could be.  Only ids and sizes are shuffled.
With a column to pack by, such as the language, documents of one value share bins with no others: the rows of each value in a
shard are packed by themselves, and the value is shuffled too.

``sequences`` lays the token ids themselves into the bins.

Defined results: a null or empty text is its end token alone; rows of equal id are packed each by itself; all pieces of a
document are in its shard; an empty table gives no rows; null is a value to pack by like others; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, op9_token_counts

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs beside its tokens, and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 64, 8192
#: Documents packed together by a task.
SHARD_ROWS = 20_000
#: Bytes of pieces that a worker of the query remembers while it counts tokens; nothing else needs its memory then.
REMEMBERED = 192 << 20


def word_tokens(text: str = "text") -> Column:
    """White-space words of a text and an end token: the size of a document for a tokenizer of words."""
    return (F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) + 1).cast("long")


def cost(length: int) -> float:
    """Cost of a sequence of a length, in tokens."""
    return length * (1 + length / ATTENTION) + OVERHEAD


class Coming:
    """The sizes still to be packed, for the trial fillings that price an opening."""

    def __init__(self, sizes: list[int], lengths: tuple[int, ...]):
        self.lengths = sorted(lengths)
        self.price = {c: cost(c) for c in self.lengths}
        self.left: dict[int, int] = {}
        self.mask = 0  # bit s: a piece of size s is still to come
        for s in sizes:
            self.left[s] = self.left.get(s, 0) + 1
            self.mask |= 1 << s

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.mask &= ~(1 << size)

    def filled(self, room: int) -> int:
        """What the largest coming pieces that fit, one after the other, fill of a room."""
        full, mask = room, self.mask
        while fits := mask & ((2 << room) - 1):
            s = fits.bit_length() - 1
            n = min(self.left[s], room // s)
            room -= n * s
            mask &= (1 << s) - 1
        return full - room

    def cheapest(self, size: int) -> int:
        """The length to open for a piece: least cost a token of the trial contents, the shorter one on a tie."""

        def rate(c: int) -> tuple[float, int]:
            holds = size + self.filled(c - size)
            return self.price[next(x for x in self.lengths if x >= holds)] / holds, c

        return min(rate(c) for c in self.lengths if c >= size)[1]


def best_fit(sizes: list[int], lengths: tuple[int, ...], preferred: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin of each size and its start there, sizes being in decreasing order; and what each bin holds.

    Bins are opened at the length of least cost a token by trial; with ``preferred``, of those of at least that length.
    """
    choices = sorted(lengths, key=lambda c: (cost(c) / c, c))
    opened_for: dict[int, int] = {}
    coming = Coming(sizes, lengths) if preferred is None else None
    bins, starts, used = [], [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: an open bin has room r
    for size in sizes:
        if coming:
            coming.take(size)
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room]
            k = own.pop()
            if not own:
                rooms &= ~(1 << room)
        else:
            if coming:
                room = coming.cheapest(size)
            else:
                least = max(size, preferred)
                if least not in opened_for:
                    opened_for[least] = next(c for c in choices if c >= least)
                room = opened_for[least]
            k = len(used)
            used.append(0)
        bins.append(k)
        starts.append(used[k])
        used[k] += size
        left = room - size
        if left:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins, starts, used


def downsized(used: list[int], lengths: tuple[int, ...]) -> np.ndarray:
    """The smallest permitted length that holds each bin's contents."""
    lengths_ = np.array(sorted(lengths))
    return lengths_[np.searchsorted(lengths_, used)]


def pack_sizes(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, start and bin length of each size (in decreasing order), by the way of opening bins whose packing costs least."""
    found = None
    price = {c: cost(c) for c in lengths}
    for preferred in (None, *lengths):
        bins, starts, used = best_fit(sizes.tolist(), lengths, preferred)
        final = downsized(used, lengths)
        total = sum(price[c] * n for c, n in zip(*np.unique(final, return_counts=True)))
        if found is None or total < found[0]:
            found = total, np.array(bins, np.int64), np.array(starts, np.int64), final
    _, bins, starts, final = found
    return bins, starts, final[bins] if len(bins) else bins


def pack(docs: DataFrame, n_tokens: Column, lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id", by: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece (from 0), n_tokens, bin_id, bin_start (its place in the bin), bin_length, and the column
    ``by`` as text, if there is one, of which a bin holds one value.

    n_tokens is the size of a document, at least 1.
    """
    lengths = tuple(sorted(lengths))
    value = F.col(by) if by else F.lit(None)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(n_tokens, F.lit(1)).cast("long").alias("n"), value.cast("string").alias("by"))
    sized = common.materialize(rows, "sizes")
    shards = max(1, -(-sized.count() // shard_rows))
    names = ["doc_id", "piece", "n_tokens", "bin_id", "bin_start", "bin_length", "by"]

    def run(batches):
        got = [(b.column(0), b.column(1).to_numpy(), b.column(2).cast(pa.string())) for b in batches if b.num_rows]
        if not got:
            return
        ids, n = pa.chunked_array([a for a, _, _ in got], pa.int64()), np.concatenate([b for _, b, _ in got])
        values = pa.concat_arrays([c for _, _, c in got]).dictionary_encode("encode")
        kind = values.indices.to_numpy()
        pieces = -(-n // lengths[-1])
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece == pieces[row] - 1, n[row] - (pieces[row] - 1) * lengths[-1], lengths[-1])
        order = np.lexsort((piece, ids.fill_null(-(2**63)).to_numpy()[row], -size))
        first = TaskContext.get().partitionId() << 32
        found = values.dictionary.to_pylist()
        for k in sorted(range(len(found)), key=lambda k: (found[k] is not None, found[k])):
            own = order[kind[row[order]] == k]
            bins, starts, length = pack_sizes(size[own], lengths)
            own_ids = ids.take(pa.array(row[own])).combine_chunks()
            columns = [own_ids.combine_chunks() if isinstance(own_ids, pa.ChunkedArray) else own_ids, pa.array(piece[own]), pa.array(size[own]), pa.array(bins + first), pa.array(starts), pa.array(length), pa.array([found[k]] * len(own), pa.string())]
            whole = pa.RecordBatch.from_arrays(columns, names)
            first += int(bins.max()) + 1
            for a in range(0, whole.num_rows, 10_000):
                yield whole.slice(a, 10_000)

    # dealt in turn, so that no key gathers in a task; Spark sorts rows before, so that a repeated task deals them alike
    packed = sized.repartition(shards).mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", by string")
    return packed.withColumnRenamed("by", by) if by else packed.drop("by")


def pack_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", remembered: int = op9_token_counts.REMEMBERED, by: str | None = None) -> DataFrame:
    """``pack`` by the tokens that a tokenizer's file gives of each text, and an end token."""
    counted = op9_token_counts.count_tokens(docs, tokenizer, doc_id=doc_id, text=text, remembered=remembered, beside=by)
    return pack(counted, F.col("n_tokens") + 1, by=by)


def sequences(packed: DataFrame, tokens: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """bin_id, bin_length, ids (the pieces end to end, in order of bin_start) and doc_ids of each sequence.

    ``packed`` is what ``pack`` gave for the sizes of ``tokens``, which holds doc_id and ids of each document, the id being unique
    and not null.  A bin gathers one sequence, which the longest permitted length bounds.
    """
    longest = max(lengths)
    own = tokens.select(F.col("doc_id").alias("t_id"), F.col("ids").alias("t_ids"))
    cut = packed.join(own, F.col("doc_id") == F.col("t_id")).select("bin_id", "bin_length", F.struct("bin_start", "doc_id", F.slice("t_ids", (F.col("piece") * longest + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids")).alias("part"))
    whole = cut.groupBy("bin_id", "bin_length").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("bin_id", "bin_length", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of the token counts of byte_bpe_50k.json, an end token each."""
    import public_tokenizers

    return pack_texts(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)
