"""Token ids in flat binary files.

The file format: a folder of shards in ascending document order.  ``ids-<shard>.bin`` holds the ids of the shard's
documents end to end as little-endian unsigned integers, of 2 bytes if the vocabulary fits and else of 4;
``offsets-<shard>.bin`` holds n + 1 little-endian 64-bit offsets, counted in ids over all shards, of its n documents;
``docs-<shard>.bin`` holds n little-endian 64-bit document ids.  ``index.json`` lists the shards with their base (the ids of all shards
before it), documents and ids, and the width.

Writing takes one range shuffle.  Each task writes its shard under a name of its own and renames it, so a repeated task
leaves one whole file.  Only one row a shard reaches the driver, which turns the counts into bases by prefix sums; a second,
small pass lays the bases into the offsets.

Defined results: null and empty texts hold the end id alone; documents of equal id stand next to each other in the order
of their text's hash; a null id is first and reads back as null; an empty table gives an index without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, pieces

#: Stands for a null id in docs-<shard>.bin.
NULL_ID = -(2**63)
#: Bytes read from a shard at a time where its file system can't be mapped.
READ_BYTES = 8 << 20


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it; a plain path or file: is the shared mount of that name."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Encoder:
    """Ids of texts as bytes, each text ended by the end id; pieces are encoded by the library and remembered."""

    def __init__(self, path: str, width: int, end_id: int):
        self.tokenizer, self.dtype = pieces.load(path), np.dtype(f"<u{width}")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.memo = None
        if pieces.cuts_at_spaces(path):
            self.library, self.memo = pieces.Library(path), pieces.Memo(self.of_pieces)

    def of_pieces(self, found: list[str]) -> list[bytes]:
        flat, spans = self.library.encode(found)
        raw = flat.astype(self.dtype).tobytes()
        return [raw[a:b] for a, b in (spans * self.dtype.itemsize).tolist()]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.memo is None:
            return [x + self.end for x in self.ids(texts)]
        return [b"".join(values) + self.end for values in self.memo.learn([pieces.split(t) for t in texts])]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Encode docs into files under folder, which all executors must reach, and return the index."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if pieces.load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        key = (tokenizer, width, end_id)
        encoders = common.kept("token-files")
        if key not in encoders:
            encoders[key] = Encoder(*key)
        encode = encoders[key]
        shard = TaskContext.get().partitionId()
        store, base = _store(folder)
        own = f"{base}/.{shard}-{uuid.uuid4().hex}"
        sizes, names, total = [], [], 0
        with store.open_output_stream(f"{own}.ids") as out:
            for part in common.slices(batches, owner="token-files"):
                found = encode([t or "" for t in part.column(1).to_pylist()])
                sizes.extend(len(x) // width for x in found)
                names.extend(NULL_ID if i is None else i for i in part.column(0).to_pylist())
                out.write(b"".join(found))
        if not sizes:
            store.delete_file(f"{own}.ids")
            return
        store.move(f"{own}.ids", f"{base}/ids-{shard:06d}.bin")
        for kind, values in (("sizes", sizes), ("docs", names)):
            with store.open_output_stream(f"{own}.{kind}") as out:
                out.write(np.array(values, "<i8").tobytes())
            store.move(f"{own}.{kind}", f"{base}/{kind}-{shard:06d}.bin")
        total = sum(sizes)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(sizes)], "n_ids": [total]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    counted = sorted(rows.mapInArrow(write, "shard long, n_docs long, n_ids long").collect())
    listed, base = [], 0
    for r in counted:
        listed.append({"shard": r.shard, "base": base, "n_docs": r.n_docs, "n_ids": r.n_ids})
        base += r.n_ids
    index = {"width": width, "n_ids": base, "shards": listed}
    with fs.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())

    def offsets(batches):
        store, root = _store(folder)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/sizes-{shard:06d}.bin") as f:
                    sizes = np.frombuffer(f.read(), "<i8")
                own = f"{root}/.{shard}-{uuid.uuid4().hex}.offsets"
                with store.open_output_stream(own) as out:
                    out.write((start + np.concatenate([[0], np.cumsum(sizes)])).astype("<i8").tobytes())
                store.move(own, f"{root}/offsets-{shard:06d}.bin")
                yield pa.RecordBatch.from_pydict({"shard": [shard]})

    if listed:
        _shard_rows(spark, listed).mapInArrow(offsets, "shard long").count()
    return index


def _shard_rows(spark: SparkSession, listed: list[dict]) -> DataFrame:
    rows = [(x["shard"], x["base"], x["n_docs"]) for x in listed]
    return spark.createDataFrame(rows, "shard long, base long, n_docs long").repartition(max(1, len(rows)))


def _ids(store: pafs.FileSystem, path: str, dtype: np.dtype):
    """A function from (start, end) to the ids of a shard: a memory map where the file is on a mount, else ranged reads."""
    if isinstance(store, pafs.LocalFileSystem):
        mapped = np.memmap(path, dtype, "r")
        return lambda a, b: mapped[a:b]
    file = store.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)


def read_index(folder: str) -> dict:
    fs, root = _store(folder)
    with fs.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over 32-bit ids) and, if asked for, the ids of each document, from the files alone."""
    index = read_index(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not index["shards"]:
        return spark.createDataFrame([], schema)
    dtype = np.dtype(f"<u{index['width']}")

    def read(batches):
        store, root = _store(folder)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                get = _ids(store, f"{root}/ids-{shard:06d}.bin", dtype)
                with store.open_input_stream(f"{root}/offsets-{shard:06d}.bin") as f:
                    at = np.frombuffer(f.read(), "<i8")
                with store.open_input_stream(f"{root}/docs-{shard:06d}.bin") as f:
                    names = np.frombuffer(f.read(), "<i8")
                begin = 0
                while begin < len(names):
                    end = max(begin + 1, int(np.searchsorted(at, at[begin] + READ_BYTES // dtype.itemsize, "right")) - 1)
                    flat = get(at[begin] - base, at[end] - base).astype("<u4")
                    cut = (at[begin : end + 1] - at[begin]).tolist()
                    own = memoryview(flat).cast("B")
                    sums = [zlib.crc32(own[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])]
                    ids = names[begin:end]
                    columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(at[begin:end]), pa.array(np.diff(cut)), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    begin = end

    return _shard_rows(spark, index["shards"]).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch_path(spark, "token-files")
    write_tokens(common.read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, with_ids=False)
