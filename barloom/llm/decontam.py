"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it, so the search
partitions by size: items fall into size classes, and for each class documents are cut into
overlapping windows of twice the class's size.  Wherever an item stands, one window holds it and
little else, and their MinHash values often agree.  Each value is a band of its own: items and
windows that share one are candidates, which exact containment of word shingles verifies.

Items of few shingles agree too rarely with a window.  They are looked up by shingles of their own,
so many that a document without any of them has too few of the item; none of them is missed.  With
``exact`` all items are looked up so, and the search as a whole misses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import bloom
from barloom.llm.common import MASK64, map_batches, mix64, shingle_hashes, stored, utf8, word_hashes, words_of

PERCENT = 80
PERMUTATIONS = 32
#: Windows are made of blocks of this many shingles.
BLOCK = 8
#: Items of up to so many shingles are looked up exactly.
EXACT = BLOCK
#: Odd numbers; multiplying by one of them modulo 2**64 permutes the hashes.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) & MASK64 | 1 for i in range(PERMUTATIONS)], np.uint64)
#: Hashes that one step of a permutation holds.
LOOKED_AT = 2_000_000
_SALTS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))[:, None]


def size_class(n: int) -> int:
    """Blocks that hold n shingles, rounded up to 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    blocks, low = -(-n // BLOCK), 1
    while True:
        for size in (low, low * 3 // 2):
            if size >= blocks:
                return size
        low *= 2


def band_keys(least: np.ndarray, size: int) -> np.ndarray:
    """``least`` (permutations x windows) -> keys of the bands, which differ by class."""
    return mix64(least ^ (_SALTS + np.uint64(size * 0xD6E8FEB86659FD93 & MASK64)))


def shingle_keys(h: np.ndarray) -> np.ndarray:
    """Keys of single shingles, apart from those of bands."""
    return mix64(h ^ _FACTORS[0])


def item_keys(shingles: np.ndarray, percent: int = PERCENT, exact: int = EXACT) -> np.ndarray:
    """Keys of an item, given its distinct shingles: a document that shares ``percent`` of one of
    up to ``exact`` shingles has at least one of them."""
    n = len(shingles)
    if n <= exact:
        return shingle_keys(shingles[: n + 1 - max(1, -(-percent * n // 100))])
    return band_keys((shingles[None, :] * _FACTORS[:, None]).min(axis=1, keepdims=True), size_class(len(shingles))).ravel()


def window_keys(h: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Band keys of all windows of a text, given its shingle hashes in text order."""
    if not sizes:
        return h[:0]
    starts = np.arange(0, len(h), BLOCK)
    step = max(1, LOOKED_AT // len(h))  # permutations at a time, so that very long texts take little memory
    least = np.concatenate([np.minimum.reduceat(h * _FACTORS[i : i + step, None], starts, axis=1) for i in range(0, PERMUTATIONS, step)])
    out = []
    for size in sizes:
        blocks = np.minimum.reduceat(least, np.arange(0, least.shape[1], size), axis=1)
        windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
        out.append(band_keys(windows, size).ravel())
    return np.concatenate(out)


def benchmark_sets(benchmark: DataFrame, percent: int = PERCENT, exact: int = EXACT) -> DataFrame:
    """``benchmark`` (item_id, text) -> item_id, n_item, item (shingles), keys; items with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(word_hashes(words_of(t)))) for t in utf8(batch.column(1))]
        columns = [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([s.tobytes() for s in sets], pa.binary()),
            pa.array([item_keys(s, percent, exact).astype(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "n_item", "item", "keys"])

    return map_batches(benchmark.select("item_id", "text"), run, "item_id long, n_item long, item binary, keys array<long>").filter("n_item > 0")


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text) -> doc_id, item_id, n_item, n_shared:
    the pairs in which the document has at least ``percent`` of the item's five-word shingles.

    The pairs are always verified; ``exact`` also rules out that the search misses any.  Without
    it, items of more than EXACT shingles are found by MinHash: with all of an item in one window
    the chance of a miss is below 0.001, more if its shingles are spread over a long text.

    A text of fewer than five words is one shingle; a null text or one without words contains
    nothing and is contained nowhere.  Texts may be of any length: a task holds one of them with a
    few numbers for each word.  Repeated rows of either table give one result; equal items with
    different ids each have their own.  Rows without an id are left out, and so are other columns.

    All that is broadcast are filters, of bounded size, of the items' keys and of their shingles.
    Documents that share no key with any item end there; the others send on their keys and those
    of their shingles that items may have: no other can count.
    """
    n_exact = MASK64 if exact else EXACT
    items = stored(benchmark_sets(benchmark.filter("item_id is not null"), percent, n_exact).dropDuplicates(["item_id", "item"]), "items")
    lengths = [r["n_item"] for r in items.select("n_item").distinct().collect()]
    sizes, short = sorted({size_class(n) for n in lengths if n > n_exact}), any(n <= n_exact for n in lengths)
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")
    keys = items.select("item_id", F.explode("keys").alias("key"))
    totals = items.agg(F.sum(F.size("keys")), F.sum("n_item")).first()

    # everything is given twice, so that the twice-seen filters hold all of it
    known = bloom.twice_seen(keys.select("key"), lambda batch: np.repeat(batch.column(0).to_numpy().astype(np.uint64), 2), bloom.filter_bits(4 * totals[0]))
    wanted = bloom.twice_seen(items.select("item"), lambda batch: np.repeat(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), 2), bloom.filter_bits(4 * totals[1]))

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hits, sets = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            h = shingle_hashes(word_hashes(words_of(text)))
            if len(h):
                found = window_keys(h, sizes)
                if short:
                    found = np.concatenate([found, shingle_keys(h)])
                found = found[bloom.contains(known.value, found)]
                own = h[bloom.contains(wanted.value, h)] if len(found) else found
                if len(own):
                    ids.append(doc_id)
                    hits.append(np.unique(found).astype(np.int64))
                    sets.append(np.unique(own).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "keys", "shingles"])

    near = stored(map_batches(docs.select("doc_id", "text").filter("doc_id is not null"), probe, "doc_id long, keys array<long>, shingles binary"), "near")
    pairs = near.select("doc_id", F.explode("keys").alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(shared, pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])

    full = pairs.join(items.select("item_id", "n_item", "item"), "item_id").join(near.select("doc_id", "shingles"), "doc_id").select("doc_id", "item_id", "n_item", "shingles", "item")
    checked = map_batches(full, verify, "doc_id long, item_id long, n_item long, n_shared long")
    return checked.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item, all columns and rows kept, also
    those of null or empty text and those without a doc_id.  ``exact`` is that of ``contained_items``."""
    hit = contained_items(docs, benchmark, percent, exact).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


#: The same result in DuckDB.
ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM texts),
sets AS (
  SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n_item FROM sets WHERE kind = 'b')
SELECT d.id AS doc_id, i.id AS item_id, i.n_item, count(*) AS n_shared
FROM sets d JOIN items i ON d.s = i.s WHERE d.kind = 'd'
GROUP BY d.id, i.id, i.n_item HAVING count(*) * 100 >= i.n_item * 80
"""
