"""Quality rules: base counts, and bands for zstandard compression ratios.

Text that compresses far better than prose repeats itself; text that hardly compresses is noise
such as keys, hashes or encoded bytes.  How far prose compresses depends on its length, so every
length class has its own band.  Fixed chunks find a bad stretch that a long text would hide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from barloom.llm.common import map_batches, utf8

LEVEL = 3
#: (bytes from, lowest ratio kept, highest ratio kept).  Frame headers and tables alone make short
#: texts incompressible, so the shortest class has no upper limit, and limits fall with the size.
#: Each is 0.01 to 0.02 under the least that random base-64 in words of 8 to 40 letters came to in its
#: class (200 bytes 0.89, 600 bytes 0.80, 2 kB 0.75); prose of the same sizes came to 0.86, 0.70, 0.54 at most.
BANDS = (
    (0, 0.25, float("inf")), (128, 0.28, 0.955), (160, 0.28, 0.93), (192, 0.28, 0.875), (256, 0.28, 0.86), (320, 0.28, 0.845),
    (384, 0.28, 0.81), (512, 0.25, 0.785), (640, 0.25, 0.775), (768, 0.25, 0.76), (1024, 0.25, 0.745), (1536, 0.25, 0.735),
    (2048, 0.20, 0.72), (65536, 0.15, 0.65),
)
#: Chunks of this many bytes (a rest of under half of it belongs to the one before) have a band of their own.
CHUNK, CHUNK_BAND = 4096, (0.15, 0.72)
#: A document goes if more than this share of its chunks is outside the band.
BAD_CHUNKS = 0.25

WHITE_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that the text has twice or more, the first ones included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    window = ids[:n]
    for i in range(1, k):  # numbers for windows of 2, 3 ... k words; no two windows share one
        window = np.unique(window * len(seen) + ids[i : n + i], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(window)[window] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + k, -1)
    return int((np.cumsum(covered) > 0).sum())


def ratios(text: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float | None, list[float]]:
    """Compressed size over size, of the whole text and of its chunks; None for an empty text."""
    if not text:
        return None, []
    parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
    if len(parts) > 1 and 2 * len(parts[-1]) < chunk:
        parts[-2:] = [parts[-2] + parts[-1]]
    whole = len(compressor.compress(text)) / len(text)
    return whole, [len(compressor.compress(p)) / len(p) for p in parts] if len(parts) > 1 else []


def in_band(size: int, whole: float | None, chunks: list[float], bands=BANDS, chunk_band=CHUNK_BAND, bad_chunks: float = BAD_CHUNKS) -> bool:
    if whole is None:
        return False
    low, high = [(lo, hi) for least, lo, hi in bands if size >= least][-1]
    bad = sum(not chunk_band[0] <= r <= chunk_band[1] for r in chunks)
    return low <= whole <= high and bad <= bad_chunks * len(chunks)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def verdicts(ids: list, texts: list[bytes], level: int = LEVEL) -> list[tuple]:
    """The rows of ``SCHEMA`` for a batch."""
    compressor = zstandard.ZstdCompressor(level=level)
    rows = []
    for doc_id, text in zip(ids, texts):
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip(WHITE_SPACE)]
        repeats = repeated_words(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        whole, chunks = ratios(text, compressor)
        rows.append((
            doc_id, len(words), sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words)),
            sum(text.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines)), repeats,
            failed, not failed and in_band(len(text), whole, chunks), whole, len(chunks),
            sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks),
        ))
    return rows


def compression_rules(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """``docs`` (doc_id, text) -> one row a document with its counts, ratios and verdict.

    A null text counts as empty.  An empty text, or one of under ten words, fails the base rules
    and is not kept.  Repeated rows give repeated results; other columns are ignored.  No
    shuffle; a task holds one batch of texts.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = verdicts(batch.column(0).to_pylist(), utf8(batch.column(1)), level)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that ``compression_rules`` keeps, all columns as they are; no shuffle.

    A null or empty text fails the base rules, so its row goes; each of equal rows has the same verdict.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = verdicts([None] * batch.num_rows, utf8(batch.column("text")), level)
        return batch.filter(pa.array([r[7] for r in rows], pa.bool_()))

    return map_batches(docs, run, docs.schema)
