"""Two Bloom filters, for hashes seen once and hashes seen twice, filled by many tasks.

Partial filters merge in any order: ``twice = twice1 | twice2 | (once1 & once2)`` and
``once = once1 | once2``.  A hash that two tasks saw has all its bits in both once-filters, so the
twice-filter never misses a repeat; it may name some hashes that were seen once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from barloom.llm.common import pieces

#: Bits for each hash, and the most bits of a filter.  The largest twice-seen filter, the only
#: thing broadcast, is therefore 128 MB whatever the input; fuller filters only name more hashes.
BITS_PER_HASH, MOST_BITS = 16, 1 << 30
HASHES = 2
SLICE = 1 << 20
#: Hashes that a task holds before it sends its partial filters on.
HELD = 500_000

SLICES = "slice int, once binary, twice binary"


def filter_bits(hashes: int) -> int:
    return min(MOST_BITS, max(SLICE, 1 << (max(1, hashes * BITS_PER_HASH) - 1).bit_length()))


def bit_positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES places of each 64-bit hash: a row for each hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _partial(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """A task's two filters as sorted bit places, a row for each slice that has any."""
    h, n = np.unique(hashes, return_counts=True)
    places = bit_positions(h, bits)
    once, twice = np.unique(places), np.unique(places[n > 1])
    edges = np.arange(0, bits + 1, SLICE).astype(np.uint64)
    cut1, cut2 = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    rows = [(i, once[a:b], twice[c:d]) for i, (a, b, c, d) in enumerate(zip(cut1, cut1[1:], cut2, cut2[1:])) if b > a]
    low = np.uint64(SLICE - 1)
    packed = (pa.array([(r[k] & low).astype("<u4").tobytes() for r in rows], pa.binary()) for k in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *packed], ["slice", "once", "twice"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice -> the twice-seen bits of each slice."""

    def row(at: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"])

    at, once, twice = None, None, None
    for batch in batches:
        for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if i != at:
                if at is not None:
                    yield row(at, twice)
                at, once, twice = i, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
            a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            twice[b] = True
            twice[a[once[a]]] = True
            once[a] = True
    if at is not None:
        yield row(at, twice)


def twice_seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Broadcast:
    """The twice-seen filter of all hashes that ``hashes_of`` makes from the batches of ``rows``."""
    spark = rows.sparkSession

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in pieces(batches):
            held.append(hashes_of(batch))
            if sum(map(len, held)) > HELD:
                yield _partial(np.concatenate(held), bits)
                held = []
        if any(map(len, held)):
            yield _partial(np.concatenate(held), bits)

    slices = rows.mapInArrow(fill, SLICES).repartition(min(bits // SLICE, 4 * spark.sparkContext.defaultParallelism), "slice")
    whole = np.zeros(bits // 8, np.uint8)
    for r in slices.sortWithinPartitions("slice").mapInArrow(_merged, "slice int, bits binary").toLocalIterator():
        whole[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole)


def contains(whole: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter knows. Later places are looked up only where the first is set."""
    out = np.zeros(len(h), bool)
    left = np.arange(len(h))
    low, last, step = np.uint64(len(whole) * 8 - 1), np.uint64(7), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        at = (h[left] + np.uint64(i) * step[left]) & low
        left = left[(whole[at >> np.uint64(3)] >> (last - (at & last)).astype(np.uint8)) & 1 == 1]
    out[left] = True
    return out
