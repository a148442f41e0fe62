"""Shared pieces of the training-data operators.

Words are maximal runs of characters outside the six ASCII white-space
characters, which is what ``bytes.split`` yields on UTF-8; lower-casing means
A-Z only, which is what ``bytes.lower`` does.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable, shared_folder

#: Java and RE2 spelling of a run of the six white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
#: Largest number of (narrow) rows that a map-side join may replicate.
BROADCAST_ROWS = 200_000
#: Rows and bytes in one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, "16m"

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages in rows and bytes."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``small`` (materialised, narrow) is broadcast only if its count is within ``limit``, otherwise both sides are shuffled and AQE splits skewed keys."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.hint("merge").join(small, on, how)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def merged(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in their order, in batches of about ``size`` bytes; a larger batch stays as it is."""
    held, bytes_held = [], 0
    for batch in batches:
        if held and bytes_held + batch.nbytes > size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, bytes_held = [], 0
        if batch.num_rows:
            held.append(batch)
            bytes_held += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def listed(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; its own to_pylist makes an object more for each."""
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes() if column.buffers()[2] is not None else b""
    return [data[a:b] for a, b in pairwise(offsets)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLACK = np.ones(256, bool)
_BLACK[[*range(9, 14), 32]] = False


def lower_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of a text column, text after text, as places among its distinct words, and their number by text."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.empty(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    text = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    black = _BLACK[text]
    start = black.copy()
    start[1:] &= ~black[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = black[first]
    counts = np.diff(np.searchsorted(np.flatnonzero(start), offsets))
    letters, at = _LOWER[text[black]], np.flatnonzero(start[black])
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(letters))), pa.py_buffer(letters)])
    return words.dictionary_encode(), counts


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    """word -> 63-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 60_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) >> 1
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that make a shingle's hash depend on the place of each word.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """63-bit hashes of the windows of n words, in order; with fewer words, one hash of the whole sequence; none without words."""
    if not len(hashes):
        return np.empty(0, np.int64)
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out += mixed(hashes[i : len(hashes) - k + 1 + i] + _MIX[i]) * _MIX[(i + 3) % 8]
        out = out * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)
    return (mixed(out) >> np.uint64(1)).astype(np.int64)


def shingle_set(text: bytes, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's lower-cased word shingles."""
    return np.unique(window_hashes(hashes.array(words_of(text)), n))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, after which the worker gives back the memory that the task took: workers are used again by later stages."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def uniform(column, seed: str):
    """A reproducible double in (0, 1) from a column: the first 52 bits of md5(seed:value)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
