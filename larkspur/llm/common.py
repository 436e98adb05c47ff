"""What several operators share: scratch tables in the shared folder, and vectorised words and hashes of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scratch ---------------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Tables to delete at the end of each open ``scratch`` of a thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Within ``scratch`` the table is deleted at the end unless it is to be kept; a kept one is job scratch, which the cluster's clean-up
    or ``drop`` removes.
    """
    path = scratch_path(df.sparkSession, tag)
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of scratch tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialised inside, but for kept ones, are deleted at the end; nothing lazy may read them later."""
    own: list[str] = []
    outer = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(outer)
        drop(spark, own)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


#: Steps of a sample's share: it may be as small as one in so many.
SHARES = 1 << 62


def sampled(h: Column, share: Column) -> Column:
    """Whether a row belongs to a sample of some share (a number of ``SHARES``), by a 64-bit hash of it."""
    return F.shiftrightunsigned(h, 2) < share


def share_of(wanted: int, there: int) -> int:
    """The share, of ``SHARES``, that gives about ``wanted`` of so many rows, however many there are."""
    return SHARES * min(wanted, there) // max(there, 1)


# -- text in Arrow batches -------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    size = len(column) + 1
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(size, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + size].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def release() -> None:
    """Give memory that this worker no longer uses back to the system, since Spark keeps workers for the tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this worker from task to task; what others have kept here is let go, as Spark uses workers again."""
    for other in _kept.keys() - {owner}:
        del _kept[other]
    return _kept.setdefault(owner, {})


def slices(batches, text: str = "text", limit: int = SLICE_BYTES, owner: str = ""):
    """Cut record batches into runs of rows of about ``limit`` text bytes; one longer text is a run of its own.

    ``owner`` is the operator whose kept things the task uses, if it has any.
    """
    kept(owner)
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


#: ASCII white space: the word separators \x20 and \x09-\x0D.
SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_BYTE_KEY = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 10, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) <= n or _POWERS[1] == 1:
        size = max(n + 1, len(_POWERS))
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _STEP, np.uint64), dtype=np.uint64)])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The white-space words of texts laid end to end: a 64-bit hash each, and how many each text has."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        solid = ~SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = at[:-1][np.diff(at) > 0]
        first[begins] = solid[begins]
        starts = np.flatnonzero(first)
        self.counts = np.diff(np.searchsorted(starts, at))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        data, own = data[solid], np.flatnonzero(first[solid])
        if not len(own):
            self.hash = np.zeros(0, np.uint64)
            return
        length = np.diff(np.append(own, len(data)))
        place = np.arange(len(data)) - np.repeat(own, length)
        with np.errstate(over="ignore"):
            value = _BYTE_KEY[data] * _powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(value, own) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows within a text and the index of the first word of each; texts of fewer words have none."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(self.hash) - n + 1
        with np.errstate(over="ignore"):
            value = np.zeros(size, np.uint64)
            for k in range(n):
                value = mix(value * np.uint64(0xA0761D6478BD642F) + self.hash[k : k + size] + np.uint64(k + 1))
        text = self.text_of()
        whole = np.flatnonzero(text[:size] == text[n - 1 :])
        return value[whole], whole


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
