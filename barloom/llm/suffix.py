"""Removal of repeated 100-byte strings with a logarithmic family of suffix arrays.

A string's anchor is the least of the hashes of its GRAM-byte substrings, so equal strings have
equal anchors wherever they stand.  Successive strings of a text with one anchor place form a run.
A twice-seen filter over all anchors leaves the runs whose strings may stand elsewhere.  Equal runs
are one class, with its first place, so that a text with thousands of copies is indexed once.
Classes that share their anchor with others go, in order of their first places, in batches into an
index:

* a batch gets a suffix array of its text, in which equal neighbours are repeats;
* it is merge-scanned against each level of the index: a match of full length is a repeat;
* it becomes a level; levels of about equal size merge, so n batches lie in about log n levels.

The index is dealt by anchor into shards, and each shard's index is built in one task.  An anchor
with very many classes, as that of a line in thousands of texts, would be too much for a shard: its
strings go by their digests, and their first places are found by an aggregate, in each task first.
Texts are never
shuffled as a whole for this: runs travel as digests, and only classes that the index needs send
their text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import bloom
from barloom.llm.common import discard, free_shuffles, map_batches, mix64, pieces, stored, utf8

LENGTH, GRAM = 100, 24
#: Strings whose anchors are found at a time; their places must fit into 16 bits.
BLOCK = 1 << 15
#: Strings of one batch of a shard's index, at least (a class is never split).
BATCH = 16_384
#: Bytes of class texts in one shard, about.
SHARD_BYTES = 500_000
#: The strings of an anchor with more classes than this are aggregated one by one.
CROWDED = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of the k-byte substrings of some bytes, put together from those of powers of two."""
    n = len(data) - k + 1
    part, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        power = np.uint64(pow(int(_BASE), size, 1 << 64))
        if k & size:
            out = part[:n] if out is None else out * power + part[done : done + n]
            done += size
        if done == k:
            return out
        part = part[:-size] * power + part[size:]
        size *= 2


class Runs(NamedTuple):
    """Runs of some texts: number of the text, anchor, first string and number of strings."""

    text: np.ndarray
    anchor: np.ndarray
    start: np.ndarray
    count: np.ndarray


def runs(texts: list[bytes]) -> Runs:
    """The runs of each text.  Of equal grams in a string the leftmost counts, so a run never holds
    the same string twice.  An anchor is 48 bits of a hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    total, width, low = len(data) - LENGTH + 1, LENGTH - GRAM + 1, np.uint64(0xFFFF)
    found: list[list[np.ndarray]] = [[], [], []]
    for b in range(0, max(0, total), BLOCK):
        h = mix64(gram_hashes(data[b : b + BLOCK + LENGTH - 1]))
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = len(h) - width + 1
        least = np.minimum(least[:n], least[width - size : width - size + n])
        at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        for part, x in zip(found, (b + at, least[at] >> np.uint64(16), b + (least[at] & low).astype(np.int64))):
            part.append(x)
    if not found[0]:
        none = np.zeros(0, np.int64)
        return Runs(none, none.astype(np.uint64), none, none)
    starts, hashes, places = map(np.concatenate, found)
    new = np.concatenate([[True], places[1:] != places[:-1]])  # a run may go on in the next block
    starts, hashes = starts[new], hashes[new]
    cuts = np.union1d(starts, begins[begins < total])
    text = np.searchsorted(ends, cuts, "right")
    count = np.minimum(np.append(cuts[1:], total), ends[text] - LENGTH + 1) - cuts
    cuts, text, count = (x[count > 0] for x in (cuts, text, count))
    return Runs(text, mix64(hashes[np.searchsorted(starts, cuts, "right") - 1]), cuts - begins[text], count)


def repeated_anchors(docs: DataFrame) -> Broadcast:
    """The twice-seen filter over the anchors of all runs."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return bloom.twice_seen(docs.select("text"), lambda batch: runs(utf8(batch.column(0))).anchor, bloom.filter_bits(2 * size // (LENGTH - GRAM + 2)))


def known_runs(texts: list[bytes], seen: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The runs with an anchor that may stand elsewhere: text, anchor, start, count, bytes."""
    found = runs(texts)
    known = bloom.contains(seen, found.anchor)
    for i, a, s, c in zip(*(x[known].tolist() for x in (found.text, found.anchor.astype(np.int64), found.start, found.count))):
        yield i, a, s, c, texts[i][s : s + c + LENGTH - 1]


def occurrences(docs: DataFrame, seen: Broadcast) -> DataFrame:
    """The known runs of ``docs`` (doc_id, row, text): digest of the run's bytes, anchor, doc_id,
    row, pos, n strings, and ``total``, the strings up to the end of the run's last direct repeat."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        columns: list[list] = [[] for _ in range(7)]
        last = end = None
        for i, a, s, c, part in known_runs(utf8(batch.column(2)), seen.value):
            digest = xxhash.xxh3_128_digest(part)
            if digest == last and (i, s) == end:
                columns[6][-1] += c
            else:
                for column, x in zip(columns, (digest, a, ids[i], rows[i], s, c, c)):
                    column.append(x)
            last, end = digest, (i, s + c)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), *[pa.int64()] * 6))], ["digest", "anchor", "doc_id", "row", "pos", "n", "total"])

    return map_batches(docs.select("doc_id", "row", "text"), run, "digest binary, anchor long, doc_id long, row long, pos long, n long, total long")


def place_hashes(digests: list[bytes], ids: list[int], places: list[int]) -> np.ndarray:
    h = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
    return mix64(mix64(h + np.array(ids, np.int64).astype(np.uint64)) + np.array(places, np.int64).astype(np.uint64))


def shared_classes(classes: DataFrame) -> DataFrame:
    """``classes`` (digest, anchor, doc_id, pos, n) without most that share their anchor with no other."""
    several = bloom.twice_seen(classes.select("anchor"), lambda batch: batch.column(0).to_numpy().astype(np.uint64), bloom.filter_bits(classes.count()))

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(bloom.contains(several.value, batch.column(1).to_numpy().astype(np.uint64))))

    return map_batches(classes, known, classes.schema)


def class_texts(docs: DataFrame, seen: Broadcast, classes: DataFrame) -> DataFrame:
    """digest, anchor, doc_id, pos, n, text of ``classes`` (digest, doc_id, pos), of each at its first place.

    A filter of the first places goes to the documents, so that no more is shuffled; the few other
    places that it lets through come after a class's first one and are dropped by the index.
    """
    n = classes.count()
    # every place is given twice, so that the twice-seen filter holds all of them
    wanted = bloom.twice_seen(classes.select("digest", "doc_id", "pos"), lambda batch: np.repeat(place_hashes(*(c.to_pylist() for c in batch.columns)), 2), bloom.filter_bits(2 * n))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        found = [(xxhash.xxh3_128_digest(part), a, ids[i], s, c, part) for i, a, s, c, part in known_runs(utf8(batch.column(1)), seen.value)]
        columns = [list(c) for c in zip(*found)] or [[] for _ in range(6)]
        kept = pa.array(bloom.contains(wanted.value, place_hashes(columns[0], columns[2], columns[3])))
        types = (pa.binary(), *[pa.int64()] * 4, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["digest", "anchor", "doc_id", "pos", "n", "text"]).filter(kept)

    return map_batches(docs.select("doc_id", "text"), run, "digest binary, anchor long, doc_id long, pos long, n long, text binary")


class SuffixArray(NamedTuple):
    """Places in a text, in the order of the LENGTH-byte strings that start there."""

    text: np.ndarray
    places: np.ndarray

    def strings(self) -> np.ndarray:
        """The strings in their order, for one comparison."""
        return np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.places].view(f"S{LENGTH}").ravel()


def suffix_array(text: np.ndarray, places: np.ndarray) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of some places of a text, and which of its strings equal the one before.

    Ranks of prefixes double in length until those of LENGTH bytes are known.  Equal strings stay
    in the order of their places.
    """
    n = len(text) - LENGTH + 1
    pairs, size = text.astype(np.uint64), 1
    while size < 8:  # the first eight bytes are a number themselves
        pairs, size = pairs[:-size] << np.uint64(8 * size) | pairs[size:], 2 * size
    rank = np.unique(pairs, return_inverse=True)[1]
    while size < LENGTH:
        step = min(size, LENGTH - size)  # two ranks may overlap
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, size = np.unique(pairs, return_inverse=True)[1], size + step
    own = rank[:n][places]
    order = np.argsort(own, kind="stable")
    equal = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    return SuffixArray(text, places[order]), equal


class Levels:
    """Suffix arrays of batches, merged so that each level has at least twice the next one's size.

    Only the fact that a string has come before counts, so a level has equal strings once.
    """

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def add(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Index a batch; which of its strings have come before, in it or in an earlier batch."""
        array, again = suffix_array(text, places)
        out = np.zeros(len(text), bool)
        out[array.places[again]] = True
        fresh = SuffixArray(text, array.places[~again])
        for level in self.levels:
            known = self.scan(level, fresh)
            out[fresh.places[known]] = True
            fresh = SuffixArray(text, fresh.places[~known])
        while self.levels and len(self.levels[-1].places) < 2 * len(fresh.places):
            fresh = self.merged(self.levels.pop(), fresh)
        if len(fresh.places):
            self.levels.append(fresh)
        return out[places]

    @staticmethod
    def merge_order(a: SuffixArray, b: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Both arrays' strings in order, and the order; a stable sort merges two sorted runs in one scan."""
        both = np.concatenate([a.strings(), b.strings()])
        order = np.argsort(both, kind="stable")
        return both[order], order

    @classmethod
    def scan(cls, level: SuffixArray, batch: SuffixArray) -> np.ndarray:
        """Which strings of the batch's array match one of the level's in full length."""
        strings, order = cls.merge_order(level, batch)
        match = np.flatnonzero(strings[1:] == strings[:-1]) + 1  # the level's comes first
        known = np.zeros(len(batch.places), bool)
        known[order[match] - len(level.places)] = True
        return known

    @classmethod
    def merged(cls, a: SuffixArray, b: SuffixArray) -> SuffixArray:
        """One array of two without a common string, over both texts."""
        places = np.concatenate([a.places, b.places + len(a.text)])
        return SuffixArray(np.concatenate([a.text, b.text]), places[cls.merge_order(a, b)[1]])


REPEATS = "digest binary, first int, n int, repeats binary"


def index_shard(shard: pa.Table) -> pa.Table:
    """Index the classes of a shard (digest, doc_id, pos, first, n, text: n strings from the class's
    first-th on) in order of their places -> digest, first, n, repeats: a bit for each string that
    has come before; only classes that have some."""
    rows = zip(*(shard.sort_by([("doc_id", "ascending"), ("pos", "ascending"), ("first", "ascending")]).column(c).to_pylist() for c in ("digest", "first", "n", "text")))
    levels, found, seen, batch, size = Levels(), [], set(), [], 0

    def add() -> None:
        starts = np.cumsum([0, *(len(t) for *_, t in batch)])
        places = np.concatenate([np.arange(s, s + n) for s, (*_, n, _) in zip(starts, batch)])
        again = levels.add(np.frombuffer(b"".join(t for *_, t in batch), np.uint8), places)
        for (digest, first, n, _), flags in zip(batch, np.split(again, np.cumsum([n for *_, n, _ in batch])[:-1])):
            if flags.any():
                found.append((digest, first, n, np.packbits(flags).tobytes()))

    for digest, first, n, text in rows:
        if (digest, first) in seen:  # a later place of the class
            continue
        seen.add((digest, first))
        batch.append((digest, first, n, text))
        size += n
        if size >= BATCH:
            add()
            batch, size = [], 0
    if batch:
        add()
    columns = [list(c) for c in zip(*found)] or [[], [], [], []]
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("digest", "first", "n", "repeats"), columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))})


def repeats_in_classes(docs: DataFrame, seen: Broadcast, classes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``classes`` (digest, anchor, doc_id, pos, n) -> digest, parts (first, n, repeats): the strings
    of the class that a class with an earlier first place, or the same doc_id and a smaller pos,
    has too."""
    hot = stored(classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter(F.col("classes") > crowded).select("anchor"), "hot")
    shards = max(1, (classes.agg(F.sum(F.col("n") + LENGTH - 1)).first()[0] or 0) // SHARD_BYTES)
    texts = class_texts(docs, seen, shared_classes(classes)).withColumn("first", F.lit(0))
    whole, crowd = texts, None
    if hot.limit(1).count():
        texts = stored(texts, "texts")
        firsts = classes.select("digest", "doc_id", "pos")  # without the other places that the filter lets through
        whole, crowd = texts.join(hot, "anchor", "left_anti"), crowded_repeats(texts.join(hot, "anchor", "left_semi").join(firsts, ["digest", "doc_id", "pos"], "left_semi"))
    dealt = whole.select(F.pmod("anchor", F.lit(shards)).alias("shard"), "digest", "doc_id", "pos", "first", "n", "text")
    indexed = dealt.groupBy("shard").applyInArrow(lambda t: index_shard(t), REPEATS)
    both = indexed if crowd is None else indexed.unionByName(crowd)
    return both.groupBy("digest").agg(F.collect_list(F.struct("first", "n", "repeats")).alias("parts"))


def crowded_repeats(texts: DataFrame) -> DataFrame:
    """REPEATS of classes (digest, doc_id, pos, n, text) whose anchor has very many: a row for each
    string that stands earlier.

    A string travels as a digest with the place where it starts.  The first place of each comes from
    an aggregate, so equal strings meet in each task first; strings that occur once end there.  The
    others' places then meet it in a join, whose large keys Spark splits.
    """

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            doc_id, pos, n = (batch.column(c).to_numpy() for c in (1, 2, 3))
            row = np.repeat(np.arange(len(n)), n)
            first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            digests = [xxhash.xxh3_128_digest(text[i : i + LENGTH]) for text, k in zip(batch.column(4).to_pylist(), n.tolist()) for i in range(k)]
            columns = [pa.array(digests, pa.binary()), batch.column(0).take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(doc_id[row]), pa.array(pos[row] + first)]
            yield pa.RecordBatch.from_arrays(columns, ["string", "digest", "first", "doc_id", "pos"])

    every = texts.select("digest", "doc_id", "pos", "n", "text").mapInArrow(strings, "string binary, digest binary, first int, doc_id long, pos long")
    every = stored(every, "strings")
    place = F.struct("doc_id", "pos")
    least = every.groupBy("string").agg(F.min(place).alias("least"), F.max(place).alias("last")).filter("least < last").select("string", "least")
    later = every.join(least, "string").filter(place > F.col("least")).select("digest", "first").distinct()
    return later.select("digest", "first", F.lit(1).alias("n"), F.expr("X'80'").alias("repeats"))


def repeated_strings(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``docs`` (doc_id, row, text) -> doc_id, row, pos, n, total, is_first, parts: the runs with
    strings that also start earlier.

    Of a class's first run (``is_first``) those are the ones that ``parts`` has a bit for, and
    all from ``pos + n`` to ``pos + total``; of every later run all from ``pos`` on.
    """
    spark = docs.sparkSession
    seen = repeated_anchors(docs)
    free_shuffles(spark)
    place = F.struct("doc_id", "pos")
    every = stored(occurrences(docs, seen), "runs")
    classes = every.groupBy("digest").agg(F.min(place).alias("place"), F.first("anchor").alias("anchor"), F.first("n").alias("n"))
    classes = stored(classes.select("digest", "anchor", "place.doc_id", "place.pos", "n"), "classes")
    free_shuffles(spark)
    partly = stored(repeats_in_classes(docs, seen, classes, crowded), "repeats")
    free_shuffles(spark)
    verdicts = stored(classes.select("digest", place.alias("first")).join(partly, "digest", "left"), "verdicts")
    discard(classes, partly)
    found = every.drop("anchor").join(verdicts, "digest").withColumn("is_first", place == F.col("first"))
    wanted = ~F.col("is_first") | (F.col("total") > F.col("n")) | F.col("parts").isNotNull()
    return found.filter(wanted).select("doc_id", "row", "pos", "n", "total", "is_first", F.when(F.col("is_first"), F.col("parts")).alias("parts"))


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, kept (binary), n_bytes, n_removed, n_spans.

    Each byte goes that is in a LENGTH-byte string of its text which also starts earlier: in a
    document with a smaller doc_id, or further up in the same one.  Strings are judged on the
    input.  Texts are UTF-8 bytes and may be cut inside a character, so what is kept is binary.
    Null and empty texts, and those shorter than LENGTH, lose nothing.  Rows that share a doc_id
    count as one document, none before the other.  Rows without a doc_id lose nothing and count
    nowhere.  Texts may be of any length.  Other columns are ignored; no documents give no rows.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = repeated_strings(docs.filter("doc_id is not null"), crowded)
    by_doc = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "n", "total", "is_first", "parts")).alias("found"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        compress = zstandard.ZstdCompressor(level=3)
        packed = pa.array([compress.compress(t) if t else None for t in utf8(batch.column(2))], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], packed], ["doc_id", "row", "packed"])

    def gone(size: int, spans: list[dict]) -> np.ndarray:
        """Which bytes of a text of that size go."""
        change = np.zeros(size + 1, np.int64)

        def drop(starts: np.ndarray, count: int) -> None:
            change[starts] += 1
            change[starts + count + LENGTH - 1] -= 1

        for x in spans:
            p, n, total = x["pos"], x["n"], x["total"]
            for part in x["parts"] or ():
                flags = np.unpackbits(np.frombuffer(part["repeats"], np.uint8), count=part["n"])
                drop(p + part["first"] + np.flatnonzero(flags), 1)
            if x["is_first"]:
                p, total = p + n, total - n
            if total:
                drop(np.array([p]), total)
        return np.cumsum(change[:-1]) > 0

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            rows = []
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = expand.decompress(packed) if packed else b""
                if not spans:
                    rows.append((text, len(text), 0, 0))
                    continue
                out = gone(len(text), spans)
                kept = np.frombuffer(text, np.uint8)[~out].tobytes()
                rows.append((kept, len(text), len(text) - len(kept), int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.large_binary(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), columns[0].cast(pa.binary()), *columns[1:]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    # texts are shuffled packed, which zstandard does better than Spark's own codec
    packed = map_batches(docs, pack, "doc_id long, row long, packed binary")
    return packed.join(by_doc, ["doc_id", "row"], "left").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``remove_repeats`` leaves."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same result in DuckDB, on hexadecimal text.
ORACLE = r"""
WITH hexed AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS p FROM hexed),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM starts),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1),
gaps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM later),
grouped AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM gaps),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM grouped GROUP BY doc_id, span),
pieces AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte, b FROM spans),
kept AS (
  SELECT x.doc_id, string_agg(substr(x.h, 2 * p.from_byte + 1, 2 * (p.a - p.from_byte)), '' ORDER BY p.a) || substr(any_value(x.h), 2 * max(p.b) + 1) AS k,
         sum(p.b - p.a) AS removed, count(*) AS n_spans
  FROM pieces p JOIN hexed x ON p.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT x.doc_id, CAST(len(x.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.k, x.h))) AS kept_sha256
FROM hexed x LEFT JOIN kept k ON x.doc_id = k.doc_id
"""
