"""Similarity join of documents by the Jaccard similarity of their word shingles.

The join is a T-occurrence search.  A document that is similar to a query shares at least T of its
shingles, so it stands in at least T of the query's inverted lists.  DivideSkip does the search on
two scales, each time with the lists split into short ones, which are merged, and L long ones:

* over the corpus L is T - 1.  The n - T + 1 shortest lists of a query are merged, as a join of
  the lists' entries; whatever shares T shingles is in one of them.  The long lists are never
  shuffled, and a list brings two documents together only if both have T - 1 shingles after it;
* over the candidates so found, a bounded number at a time, L follows from T and the longest list:
  short lists are merged with a heap, and the long ones are probed, by binary search, for those
  with T - L occurrences so far.

Before the second step pairs are dropped whose parity sketches differ in too many bits, which rules
out most documents of a group that are only almost similar enough.

Equal shingle sets are one class with one representative.  Large groups of near copies first meet
through hubs: each list compares its documents with one of them.  Only documents that are then in
different components are compared with the rest of their lists, so most pairs of a group are never
made, and no link that could join two components is lost.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import bloom
from barloom.llm.common import discard, free_shuffles, map_batches, mix64, pieces, shingle_hashes, stored, utf8, word_hashes, words_of
from barloom.llm.components import grown

SHINGLE, PERCENT = 5, 80
#: One document in LIST_SAMPLE, picked by its id, tells which lists are long.  This sets only the
#: order in which shingles count as rare; any order gives the same links.
LIST_SAMPLE = 8
#: Lists that come out as long, at most; the table of them is broadcast (8 bytes each).
LONG_LISTS = 500_000
#: Rounds with hubs go on while they find more than a WORTH of the links of the first round, and for
#: HUB_ROUNDS at most.
WORTH, HUB_ROUNDS = 0.05, 6
#: Candidates that one search holds at a time, and their shingles, about.
CANDIDATES, CHUNK = 100, 400_000
#: Longs in the parity sketch of a set.
SKETCH = 8
#: Up to so many representatives are looked up by a broadcast of their ids (8 bytes each).
FEW = 1_000_000
#: DivideSkip's constant: L = T / (MU * log2(longest list) + 1).
MU = 0.0085


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), k))


def required(n: int, m: int, percent: int = PERCENT) -> int:
    """Shingles that sets of n and m must share: 100 * both >= percent * either."""
    return -(-percent * (n + m) // (100 + percent))


class Lists:
    """Inverted lists of some sorted shingle sets: ascending numbers of the sets that have a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(x) for x in sets]
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.starts = np.unique(values[order], return_index=True)
        self.ends = np.append(self.starts, len(values))[1:]

    def of(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's shingles that are not empty, the shortest first."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        return [self.owners[i:j].tolist() for i, j in zip(self.starts[at], self.ends[at])]


def divide_skip(query: np.ndarray, candidates: Lists, percent: int = PERCENT, mu: float = MU) -> list[bool]:
    """Which candidates share as many shingles with the query, a sorted set, as they must."""
    lists, out = candidates.of(query), [False] * len(candidates.sizes)
    if not lists:
        return out
    needed = [required(len(query), n, percent) for n in candidates.sizes]
    least = min(needed)
    n_long = min(len(lists), max(0, least - 1), int(least / (mu * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for c, run in groupby(heapq.merge(*short)):
        found = sum(1 for _ in run)
        for left, probed in zip(range(n_long, 0, -1), long):
            if found >= needed[c] or found + left < needed[c]:
                break
            i = bisect_left(probed, c)
            found += i < len(probed) and probed[i] == c
        out[c] = found >= needed[c]
    return out


def long_lists(docs: DataFrame) -> np.ndarray:
    """Shingles of the longest lists, from the longest on, as a sample of the documents shows."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(LIST_SAMPLE)) == 0).select("text")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = {s.tobytes() for s in map(shingle_set, utf8(batch.column(0)))}  # copies count once
            keys = np.frombuffer(b"".join(sets), np.int64)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000])], ["key"])

    counted = some.mapInArrow(spread, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    longest = counted.orderBy(F.desc("n"), "key").limit(LONG_LISTS)
    return np.array([r["key"] for r in longest.select("key").toLocalIterator()], np.int64).astype(np.uint64)


def rarest(s: np.ndarray, keys: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shortest lists of a set, of which every similar set is in one: short ones in the order
    of their hashes, then long ones, the longest last."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    if not len(keys):
        return s[:n]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, ranks[at], 0), kind="stable")[:n]]


def parity_sketch(s: np.ndarray) -> list[int]:
    """For each of 64 * SKETCH bits, whether an odd number of the shingles falls on it.

    Shingles that two sets share cancel out, so their sketches differ in no more bits than the sets
    in shingles."""
    odd = np.bincount((mix64(s) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def signatures(docs: DataFrame, long: Broadcast, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), part (the shingles of ``rarest``), sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ranks = long.value
        sets = [shingle_set(t) for t in utf8(batch.column(1))]
        columns = [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([rarest(s, keys, ranks, percent).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            pa.array(list(map(parity_sketch, sets)), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "part", "sketch"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, digest binary, part binary, sketch array<long>")


def shared_only(marks: DataFrame) -> DataFrame:
    """``marks`` with those shingles of their parts that a twice-seen filter knows (few are left, as most
    shingles stand in one document alone), their places in the part, and how many are lost."""
    n = marks.select(F.sum(F.length("part")) / 8).first()[0] or 0
    known = bloom.twice_seen(marks.select("part"), lambda batch: np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), bloom.filter_bits(int(n) // 2))

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
        kept = [np.flatnonzero(bloom.contains(known.value, x)) for x in parts]
        columns = [
            pa.array([len(x) - len(k) for x, k in zip(parts, kept)], pa.int64()),
            pa.array([x[k].tobytes() for x, k in zip(parts, kept)], pa.binary()),
            pa.array([k.astype("<i4").tobytes() for k in kept], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, batch.column(4)], ["doc_id", "n", "digest", "lost", "keys", "places", "sketch"])

    return map_batches(marks.select("doc_id", "n_shingles", "digest", "part", "sketch"), prune, "doc_id long, n long, digest binary, lost long, keys binary, places binary, sketch array<long>")


def _required(n: F.Column, m: F.Column, percent: int) -> F.Column:
    return F.ceil(percent * (n + m) / (100 + percent))


def postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``classes`` (rep, n, lost, keys, places) -> key, rep, n, lost, place: the lists, without the
    representatives that can't be similar to any other in the list, by its size or its place."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            parts = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            keys, places = np.concatenate(parts), np.frombuffer(b"".join(batch.column(4).to_pylist()), "<i4").astype(np.int64)
            own = [np.repeat(batch.column(i).to_numpy(), [len(x) for x in parts]) for i in range(3)]
            for i in range(0, len(keys), 100_000):
                columns = [pa.array(x[i : i + 100_000]) for x in (keys, *own, places)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "rep", "n", "lost", "place"])

    lists = classes.select("rep", "n", "lost", "keys", "places").mapInArrow(spread, "key long, rep long, n long, lost long, place long")
    by_size = Window.partitionBy("key").orderBy("n")
    near = lists.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size), "least": F.min("n").over(by_size)})
    near = near.filter((100 * F.col("less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("more")))
    smallest = F.greatest("least", F.ceil(percent * F.col("n") / 100))  # similar set in the list
    return near.filter(F.col("place") <= F.col("n") - _required(F.col("n"), smallest, percent)).select("key", "rep", "n", "lost", "place")


def search(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (a, b: a is the query; m shingles of b) and ``texts`` (rep, text) -> the similar
    a, b.

    A query's candidates are dealt into chunks of about CANDIDATES and CHUNK shingles, and each
    chunk is searched on its own, so a hub with very many candidates isn't one task's work.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / CANDIDATES, F.sum("m") / CHUNK)).alias("chunks"))
    dealt = stored(pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b"), "dealt")
    own = dealt.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("rep"), F.lit(True).alias("is_query"))
    wanted = dealt.select("a", "chunk", F.col("b").alias("rep"), F.lit(False).alias("is_query")).union(own)
    ids = wanted.select("rep").distinct()
    if dealt.count() <= FEW // 2:
        texts = texts.join(F.broadcast(ids), "rep", "left_semi")
    rows = wanted.join(texts, "rep").select("a", "chunk", "rep", "is_query", "text")

    def one(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("rep").to_pylist(), group.column("is_query").to_pylist(), map(shingle_set, utf8(group.column("text")))))
        others = [(b, s) for b, is_query, s in rows if not is_query]
        lists = Lists([s for _, s in others])
        # a doc_id with several texts has several queries
        found = [divide_skip(s, lists, percent) for _, is_query, s in rows if is_query]
        hits = [b for (b, _), *ok in zip(others, *found) if any(ok)]
        return pa.table({"a": pa.array([group.column("a")[0].as_py()] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return rows.groupBy("a", "chunk").applyInArrow(one, "a long, b long")


def apart(posts: DataFrame, found: DataFrame) -> DataFrame:
    """The lists with documents of several components, with these: key, rep, n, lost, place, component."""
    own = posts.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    return own.join(mixed.select("key"), "key", "left_semi")


def meet(few: DataFrame, lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of one of ``few`` (x) and another document in its list (y) that lie in different
    components and have enough shingles left, after the list, to be similar."""
    x, y = few.alias("x"), lists.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    needed = _required(n, m, percent)
    both = x.join(y, F.col("x.key") == F.col("y.key")).filter(F.col("x.component") != F.col("y.component"))
    return both.filter((F.col("x.place") <= n - needed) & (F.col("y.place") <= m - needed))  # sizes too far apart fail here too


def _may_link(a: str, b: str, n: F.Column, m: F.Column, percent: int) -> F.Column:
    """Sets of n and m shingles with these sketches can be similar."""
    bits = reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH)))
    return bits <= n + m - 2 * _required(n, m, percent)


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sketches (rep, n, sketch) differ in no more bits than the sets may in
    shingles; with m, the shingles of b. No pair that links is lost."""
    for end, size in (("a", "_n"), ("b", "m")):
        pairs = pairs.join(sketches.select(F.col("rep").alias(end), F.col("n").alias(size), F.col("sketch").alias(f"_{end}")), end)
    return pairs.filter(_may_link("_a", "_b", F.col("_n"), F.col("m"), percent)).drop("_n", "_a", "_b")


def similar_classes(posts: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``posts`` (key, rep, n, lost, place), ``texts`` (rep, text), ``sketches`` (rep, n, sketch) ->
    node, component of linked classes.

    The first hub of a list is the document that has lost least of its part, as what it shares
    with others makes it likely to be in the midst of a group; later hubs are picked by a hash.
    """
    spark = posts.sparkSession
    found, tables = spark.createDataFrame([], "node long, component long"), []
    tested, hubs, first = spark.createDataFrame([], "low long, high long"), True, 0
    for turn in range(HUB_ROUNDS + 1):
        lists = stored(apart(posts, found), "lists")
        posts = lists.drop("component")
        last = not hubs or turn == HUB_ROUNDS
        if not last:
            order = F.struct(F.col("lost") if turn == 0 else F.lit(0), F.xxhash64("rep", F.lit(turn)))
            few = lists.groupBy("key").agg(F.min_by(F.struct("rep", "n", "place", "component"), order).alias("hub")).select("key", "hub.*")
            met = meet(few, lists, percent)
        else:  # all that is outside the list's largest component against the rest
            sizes = lists.groupBy("key", "component").agg(F.count("*").alias("size"))
            main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
            sketched = lists.join(sketches.select("rep", "sketch"), "rep")
            met = meet(sketched.join(main, "key").filter("component <> main"), sketched, percent)
            met = met.filter((F.col("y.component") == F.col("x.main")) | (F.col("x.rep") < F.col("y.rep")))
            met = met.filter(_may_link("x.sketch", "y.sketch", F.col("x.n"), F.col("y.n"), percent))
        low, high = F.least("x.rep", "y.rep").alias("low"), F.greatest("x.rep", "y.rep").alias("high")
        pairs = met.groupBy(low, high).agg(F.min(F.struct(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))).alias("pair"))
        pairs = pairs.join(tested, ["low", "high"], "left_anti").select("low", "high", "pair.*")
        pairs = stored(near_enough(pairs, sketches, percent), "pairs")
        links = stored(search(pairs, texts, percent), "links")
        gained = links.count()
        first = first if turn else gained
        hubs = gained > WORTH * first
        tables.append(found)
        found = grown(found, links)
        tested = tested.union(pairs.select("low", "high"))
        tables += [lists, pairs, links]
        if last:
            break
    discard(*tables)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id.

    A document's set has its distinct shingles of five words; with fewer words, the whole
    sequence; without words, or with a null text, nothing, and it links with nothing.  Two
    documents link at a Jaccard similarity of ``percent``; ``component_id`` is the smallest
    doc_id that links reach.  Texts may be of any length: a task holds one of them with a few
    numbers for each word.  Rows that share a doc_id and set are one document, and each of them
    has its row in the result; a doc_id with different texts links them all.  Rows without a
    doc_id get their n_shingles and no component.  Other columns are ignored; no documents give
    no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keys = long_lists(docs)
    order = np.argsort(keys)
    long = spark.sparkContext.broadcast((keys[order], len(keys) - order))  # the longest list has the highest rank
    marks = stored(signatures(docs, long, percent), "signatures")
    own = stored(marks.drop("part", "sketch"), "digests")
    usable = marks.filter("doc_id is not null and n_shingles > 0")
    first = shared_only(usable).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "n", "lost", "keys", "places", "sketch")).alias("first"))
    classes = stored(first.select("digest", "first.*"), "classes")
    discard(marks)
    free_shuffles(spark)
    posts = stored(postings(classes, percent), "postings")
    reps = stored(classes.select("digest", "rep"), "representatives")
    sketches = stored(classes.select("rep", "n", "sketch").join(posts.select("rep").distinct(), "rep", "left_semi"), "sketches")
    discard(classes)
    texts = stored(docs.withColumnRenamed("doc_id", "rep").join(posts.select("rep").distinct(), "rep", "left_semi"), "texts")
    free_shuffles(spark)
    found = similar_classes(posts, texts, sketches, percent)
    discard(posts, texts, sketches)
    free_shuffles(spark)
    reached = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("reached"))
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    joined = own.withColumn("digest", F.when(~empty, F.col("digest"))).join(reached, "digest", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").alias("component_id"))


#: The same result in DuckDB.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
posts AS (SELECT rep, n, hash(unnest(s)) AS shingle FROM classes),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM posts a JOIN posts b ON a.shingle = b.shingle AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rep AS node, rep AS target FROM classes UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.target = e.x),
found AS (SELECT node, min(target) AS component_id FROM reach GROUP BY node)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(f.component_id, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) LEFT JOIN found f ON f.node = c.rep
"""
