"""Line dedup with two Bloom filters, for line keys seen once and seen twice.

One pass over the texts fills the filters (see ``bloom``).  A second pass sends only the lines that the twice-seen filter knows to a shuffle, which confirms them by
their exact keys and finds the document that keeps them.  The filters decide nothing: when they
are too full, more lines are shuffled, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import bloom
from barloom.llm.common import pieces, utf8

MIN_CHARS, MIN_DOCUMENTS = 20, 3
WHITE_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The line stripped and with A-Z lower-cased; None if it is shorter than MIN_CHARS."""
    key = line.strip(WHITE_SPACE).lower()
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return key


def line_keys(text: bytes) -> dict[bytes, None]:
    """Distinct keys of a text, in order."""
    keys = dict.fromkeys(map(line_key, text.split(b"\n")))
    keys.pop(None, None)
    return keys


def key_hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, keys)), np.uint64)


def repeated_keys(docs: DataFrame) -> Broadcast:
    """The twice-seen filter over the distinct line keys of each document."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    return bloom.twice_seen(docs.select("text"), lambda batch: key_hashes([k for t in utf8(batch.column(0)) for k in line_keys(t)]), bloom.filter_bits(lines))


def suspected_lines(docs: DataFrame) -> DataFrame:
    """Each document's distinct line keys that the twice-seen filter knows: doc_id, key, digest."""
    seen = repeated_keys(docs)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, keys = [], []
            for doc_id, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = list(line_keys(t))
                ids.extend([doc_id] * len(own))
                keys.extend(own)
            known = bloom.contains(seen.value, key_hashes(keys))
            for i in range(0, len(hits := np.flatnonzero(known)), 20_000):
                part = hits[i : i + 20_000]
                chosen = [keys[j] for j in part]
                columns = [pa.array([ids[j] for j in part], pa.int64()), pa.array(chosen, pa.binary()), pa.array(list(map(xxhash.xxh3_128_digest, chosen)), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "digest"])

    return docs.select("doc_id", "text").mapInArrow(probe, "doc_id long, key binary, digest binary")


def dropped_keys(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, dropped: digests of the line keys that each document loses."""
    suspects = suspected_lines(docs.filter("doc_id is not null"))
    # rows of one doc_id are one document, however often it is repeated
    own = suspects.groupBy("key", "doc_id").agg(F.first("digest").alias("digest"))
    repeats = own.groupBy("key").agg(F.first("digest").alias("digest"), F.max("doc_id").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    losers = suspects.select("doc_id", "digest").join(repeats.select("digest", "keeper"), "digest").filter("doc_id < keeper")
    return losers.groupBy("doc_id").agg(F.collect_set("digest").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text, n_lines, n_dropped, and the columns in ``carry``.

    A line goes if its key has at least MIN_CHARS code points and stands in at least
    MIN_DOCUMENTS documents, except in the one with the largest doc_id.  ``n_lines`` counts the
    lines before.  Null and empty texts are one empty line.  Rows that share a doc_id count as
    one document.  Rows without a doc_id keep all lines and count nowhere.  Other columns are
    left out.  A line that very many documents share is counted before the shuffle; the join that
    finds who loses it has one row a key on one side, so adaptive execution can split it.
    """
    names = {f"carry_{i}": c for i, c in enumerate(carry)}
    slim = docs.select("doc_id", "text", *(F.col(c).alias(n) for n, c in names.items()))
    joined = slim.join(dropped_keys(docs), "doc_id", "left")
    fields = {f.name: f for f in slim.schema.fields}
    schema = ", ".join(["doc_id long, text string, n_lines long, n_dropped long", *(f"{n} {fields[n].dataType.simpleString()}" for n in names)])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, lines, gone = [], [], []
            for t, lost in zip(utf8(batch.column("text")), batch.column("dropped").to_pylist()):
                every = t.split(b"\n")
                left = every
                if lost:
                    lost = set(lost)
                    left = [x for x in every if (k := line_key(x)) is None or xxhash.xxh3_128_digest(k) not in lost]
                texts.append(b"\n".join(left))
                lines.append(len(every))
                gone.append(len(every) - len(left))
            own = [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(n) for n in names)], ["doc_id", "text", "n_lines", "n_dropped", *names])

    return joined.mapInArrow(cut, schema).withColumnsRenamed(names)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what ``drop_repeated_lines`` leaves."""
    cut = drop_repeated_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same result in DuckDB.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeats r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
