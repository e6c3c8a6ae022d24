"""Small helpers that several corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.sources.tables import discard, shared_folder, stored  # noqa: F401

#: Rows that are worked on together; Spark itself bounds an Arrow batch to 64 MB
#: (spark.sql.execution.arrow.maxBytesPerBatch), so very long texts come in batches of few rows.
BATCH_ROWS = 1000
#: Entries that a worker keeps in a word cache before it starts a new one.
CACHE_ENTRIES = 300_000

MASK64 = (1 << 64) - 1


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of BATCH_ROWS rows at most, without a copy."""
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished phases now, not whenever the driver
    happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for functions that turn each batch into one batch (or none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word (bytes), kept for the words that come again."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES and len(word) < 64:
            self[word] = h
        return h


_hashes = WordHashes()

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MULTIPLIERS[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


def words_of(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text whose A-Z are lower-cased; other letters stay."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word windows of a text, given its word hashes, in text order.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    n = len(h)
    if n == 0:
        return h
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * _MULTIPLIERS[2] + h[i : n - size + 1 + i])
    return out


def held_out() -> F.Column:
    """The rows that no model learns from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
