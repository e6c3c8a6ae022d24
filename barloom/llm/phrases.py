"""Phrase collocations: contiguous word n-grams that occur far more often together than apart.

Words that occur often enough are dictionary-encoded, each language's apart from the others'; a
piece of text breaks at every other word, as no phrase with a rare word can be frequent.  What is
left is kept as blocks of 32-bit ids.  Phrases of two to four words are keys of 16 bytes, four
big-endian ids with zeros at the end.  Each task radix-sorts the keys of a block by digits of 16
bits and counts their runs, so a phrase is sent once for a block and not once for an occurrence;
the counted keys are range-partitioned and sorted by Spark, and runs are counted again.

Pairs are counted first.  A longer phrase is packed only where a Bloom filter knows all its pairs
as frequent; the filter decides nothing, as the counts are exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import bloom
from barloom.llm.common import CACHE_ENTRIES, discard, mix64, pieces, stored, utf8

#: Occurrences that make a phrase a candidate; phrases that a language keeps.
LEAST, TOP = 30, 2000
#: A candidate goes if a longer one has at least so many hundredths of its occurrences.
CONTAINED_PERCENT = 80
#: Parts of the score: it is a whole number.
SCALE = 2_000_000
LONGEST, KEY_BYTES = 4, 16

#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 500_000
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 1 << 22
#: Ids that are packed, and n-grams that a task sorts, at once.
BLOCK_IDS, HELD_GRAMS = 1 << 19, 1 << 21
#: Words of the dictionary that are broadcast at once, eight bytes each.  A larger dictionary takes
#: more passes over the blocks, one for each part.
BROADCAST_WORDS = 8_000_000

BREAK = b"."
#: The characters that end a piece, and those between words.
_PUNCTUATION, _SPACES = b".,;:!?\n\x0b\x0c\r", b"\t "
_TO_BREAKS = bytes.maketrans(_PUNCTUATION + _SPACES, BREAK * len(_PUNCTUATION) + b" " * len(_SPACES))

WORDS = "lang string, word binary, hash long, n long"
BLOCKS = "ids binary, n_tokens long"
KEYS = "key binary, n long"


def words_and_breaks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of the texts in order, A-Z lower-cased, with a BREAK wherever a piece or a text ends;
    in lists of a few megabytes, however long the texts are."""
    data = BREAK.join(texts).lower().translate(_TO_BREAKS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SPLIT_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(BREAK, b" . ").split()
        at = end


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
        out[lang].append(text)
    return out


def _seed(lang: str, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), salt)


def word_hash(word: bytes, seed: int) -> int:
    """62 bits, so that it is no negative number."""
    return xxhash.xxh3_64_intdigest(word, seed) >> 2


def word_counts(docs: DataFrame, least: int, salt: int) -> DataFrame:
    """Words with at least ``least`` occurrences; a row without a word has a language's total."""

    def emit(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            seed, words = _seed(lang, salt), list(counts)
            columns = [
                pa.array([lang] * (len(words) + 1), pa.string()), pa.array([*words, None], pa.binary()),
                pa.array([*(word_hash(w, seed) for w in words), 0], pa.int64()), pa.array([*counts.values(), counts.total()], pa.int64()),
            ]
            yield from pieces([pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in pieces(batches):
            for lang, texts in _by_language(batch).items():
                for words in words_and_breaks(texts):
                    held[lang].update(words)
                del held[lang][BREAK]
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from emit(held)
                held.clear()
        yield from emit(held)

    return docs.mapInArrow(count, WORDS).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull())


def numbered(words: DataFrame) -> DataFrame:
    """The words with ids from 1, in the order of their hashes; one row a partition is summed up."""
    ordered = stored(words.repartitionByRange("hash").sortWithinPartitions("hash").withColumn("_at", F.monotonically_increasing_id()), "dictionary")
    placed = ordered.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select("lang", "word", "hash", "n", (F.col("_start") + F.col("_row") + 1).alias("id"))


def looked_up(hashes: np.ndarray, known: np.ndarray, first: int) -> np.ndarray:
    """Ids of the hashes in this part of the dictionary; the others' hashes as negative numbers."""
    at = np.searchsorted(known, hashes)
    found = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
    return np.where(found, first + at, -1 - hashes)


def trimmed(ids: np.ndarray) -> np.ndarray:
    """Without words that have no neighbour, and with one zero for each break; a zero at either end."""
    ids = np.concatenate([[0, 0], np.maximum(ids, 0), [0, 0]])
    joined = (ids[:-1] > 0) & (ids[1:] > 0)
    alone = ~np.concatenate([[False], joined]) & ~np.concatenate([joined, [False]])
    ids[alone] = 0
    return ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])].astype("<i4")


def _blocks(ids: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    packed = trimmed(ids) if last else ids.astype("<i8")
    n = int((ids > 0).sum())
    if len(packed) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary()), pa.array([n if last else 0], pa.int64())], ["ids", "n_tokens"])
    elif last and n:
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([n], pa.int64())], ["ids", "n_tokens"])


def encoded(docs: DataFrame, known: Broadcast, last: bool, salt: int) -> DataFrame:
    """Blocks of the texts by the first part of the dictionary."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        caches: dict[str, dict[bytes, int]] = defaultdict(dict)
        for batch in pieces(batches):
            if sum(map(len, caches.values())) > CACHE_ENTRIES:
                caches.clear()
            parts = []
            for lang, texts in _by_language(batch).items():
                seed, cache = _seed(lang, salt), caches[lang]
                cache[BREAK] = 0
                for words in words_and_breaks(texts):
                    new = list(set(words) - cache.keys())
                    hashes = np.fromiter((word_hash(w, seed) for w in new), np.int64, len(new))
                    cache.update(zip(new, looked_up(hashes, table, 1).tolist()))
                    parts.append(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)))
                    for w in new:
                        if len(w) > 64:
                            del cache[w]
                parts.append(np.zeros(1, np.int64))
            if parts:
                yield from _blocks(np.concatenate(parts), last)

    return docs.mapInArrow(encode, BLOCKS)


def encoded_further(blocks: DataFrame, known: Broadcast, first: int, last: bool) -> DataFrame:
    """The blocks with the words of a further part of the dictionary encoded too."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ids = np.frombuffer(block, "<i8").copy()
                left = np.flatnonzero(ids < 0)
                ids[left] = looked_up(-1 - ids[left], known.value, first)
                yield from _blocks(ids, last)

    return blocks.mapInArrow(encode, BLOCKS)


def encode_documents(docs: DataFrame, dictionary: DataFrame, n_words: int, salt: int) -> DataFrame:
    """Stored blocks of ids; a zero stands for each break."""
    spark = docs.sparkSession
    blocks, parts = None, range(0, max(1, n_words), BROADCAST_WORDS)
    for start in parts:
        part = dictionary.filter(F.col("id").between(start + 1, start + BROADCAST_WORDS)).select("hash").toArrow()  # bounded by BROADCAST_WORDS
        known = spark.sparkContext.broadcast(np.sort(part.column(0).to_numpy().astype(np.int64)))
        last, before = start == parts[-1], blocks
        blocks = stored(encoded(docs, known, last, salt) if before is None else encoded_further(before, known, start + 1, last), "blocks")
        if before is not None:
            discard(before)
        known.destroy()
    return blocks


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """Rows of 32-bit ids in ascending order, by stable passes over digits of 16 bits from the last
    to the first (numpy sorts 16-bit integers by radix). Digits that are all equal take no pass."""
    order = None
    for column in range(keys.shape[1] - 1, -1, -1):
        for digit in (keys[:, column].astype(np.uint16), (keys[:, column] >> 16).astype(np.uint16)):
            if len(digit) and digit.min() != digit.max():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return keys if order is None else keys[order]


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal rows begins, and how long it is."""
    starts = np.flatnonzero(np.concatenate([[True] * (len(keys) > 0), (keys[1:] != keys[:-1]).any(axis=1)]))
    return starts, np.diff(np.append(starts, len(keys)))


def pair_hashes(ids: np.ndarray) -> np.ndarray:
    """Hashes of the rows' first two ids."""
    return mix64((ids[:, 0].astype(np.uint64) << np.uint64(32)) | ids[:, 1].astype(np.uint64))


def packed(ids: np.ndarray, sizes: Iterable[int], pairs: np.ndarray | None, end: int) -> np.ndarray:
    """Keys of the n-grams of these sizes that start before ``end`` and lie between two zeros; if
    there is a filter, only those whose pairs it all knows."""
    there = (ids[:-1] > 0) & (ids[1:] > 0)
    if pairs is not None:
        at = np.flatnonzero(there)
        there[at] = bloom.contains(pairs, pair_hashes(np.stack([ids[at], ids[at + 1]], axis=1)))
    out = []
    for size in sizes:
        whole = there[: max(0, len(there) - size + 2)].copy()
        for i in range(1, size - 1):
            whole &= there[i : len(whole) + i]
        at = np.flatnonzero(whole[:end])
        keys = np.zeros((len(at), LONGEST), np.uint32)
        for i in range(size):
            keys[:, i] = ids[at + i]
        out.append(keys)
    return np.concatenate(out)


def _key_batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    data = np.ascontiguousarray(keys.astype(">u4"))
    offsets = np.arange(0, KEY_BYTES * (len(keys) + 1), KEY_BYTES, dtype=np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([column, pa.array(n, pa.int64())], ["key", "n"])


def _key_rows(column: pa.Array) -> np.ndarray:
    """Ids of a column of keys, a row each."""
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[start : start + KEY_BYTES * len(column)].view(">u4").reshape(-1, LONGEST).astype(np.uint32)


def frequent(blocks: DataFrame, sizes: tuple[int, ...], least: int, pairs: Broadcast | None = None) -> DataFrame:
    """key, n of the n-grams of these sizes with at least ``least`` occurrences."""

    def count(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = radix_sorted(np.concatenate(held))
        starts, n = run_lengths(keys)
        for i in range(0, len(starts), 1 << 16):
            yield _key_batch(keys[starts[i : i + (1 << 16)]], n[i : i + (1 << 16)])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ids = np.frombuffer(block, "<i4")
                for i in range(0, len(ids), BLOCK_IDS):
                    held.append(packed(ids[i : i + BLOCK_IDS + LONGEST - 1], sizes, pairs and pairs.value, BLOCK_IDS))
                    size += len(held[-1])
                    if size > HELD_GRAMS:
                        yield from count(held)
                        held, size = [], 0
        if size:
            yield from count(held)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n = np.zeros((0, LONGEST), np.uint32), np.zeros(0, np.int64)
        for batch in filter(len, batches):
            keys, n = np.concatenate([open_key, _key_rows(batch.column(0))]), np.concatenate([open_n, batch.column(1).to_numpy()])
            starts, _ = run_lengths(keys)
            sums = np.add.reduceat(n, starts)
            open_key, open_n = keys[starts[-1:]], sums[-1:]
            often = np.flatnonzero(sums[:-1] >= least)
            if len(often):
                yield _key_batch(keys[starts[often]], sums[often])
        if len(open_n) and open_n[0] >= least:
            yield _key_batch(open_key, open_n)

    return blocks.mapInArrow(pack, KEYS).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(add_up, KEYS)


def _part(first: int, words: int) -> Column:
    """The key of some of a key's words."""
    return F.expr(f"rpad(substring(key, {4 * first + 1}, {4 * words}), {KEY_BYTES}, X'00')")


def _parts(size: int) -> list[Column]:
    """A phrase's contiguous parts that matter: each cut's two, and whatever else it contains."""
    part = lambda first, words, cut, left: F.struct(_part(first, words).alias("part"), F.lit(words).alias("words"), F.lit(cut).alias("cut"), F.lit(left).alias("is_left"))
    cuts = [p for k in range(1, size) for p in (part(0, k, k, True), part(k, size - k, k, False))]
    inner = [part(1, words, 0, False) for words in range(2, size - 1)]
    return cuts + inner


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """key, lang, a, l, r, score of the phrases that no longer one contains too often.

    One join brings each part its occurrences, which give both the scores of the cuts and the parts
    that the phrase itself rules out.
    """
    none = lambda i: F.expr(f"substring(key, {4 * i + 1}, 4) = X'00000000'")
    size = F.when(none(2), 2).when(none(3), 3).otherwise(4)
    parts = F.when(size == 2, F.array(*_parts(2))).when(size == 3, F.array(*_parts(3))).otherwise(F.array(*_parts(4)))
    asked = phrases.select("key", F.col("n").alias("a"), F.explode(parts).alias("p")).select("key", "a", "p.*")
    single = words.select(F.expr(f"rpad(unhex(lpad(hex(id), 8, '0')), {KEY_BYTES}, X'00')").alias("part"), F.col("n").alias("f"), "lang")
    known = single.unionByName(phrases.select(F.col("key").alias("part"), F.col("n").alias("f")), allowMissingColumns=True)
    told = stored(asked.join(known, "part"), "parts")
    ruled_out = told.filter((F.col("words") > 1) & (F.col("a").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * CONTAINED_PERCENT)).select(F.col("part").alias("key")).distinct()
    side = lambda k, left: F.max(F.when((F.col("cut") == k) & (F.col("is_left") == left), F.col("f")))
    cuts = told.groupBy("key", "a").agg(F.max("lang").alias("lang"), *(side(k, left).alias(f"{name}{k}") for k in range(1, LONGEST) for name, left in (("l", True), ("r", False))))
    # decimals, as the product passes 64 bits
    score = lambda k: F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cut = lambda k: F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    lowest = cuts.withColumn("best", F.array_min(F.array(*(F.when(F.col(f"l{k}").isNotNull(), cut(k)) for k in range(1, LONGEST)))))
    return lowest.join(ruled_out, "key", "left_anti").select("key", "lang", "a", "best.l", "best.r", "best.score")


def ranked(scores: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Each language's first phrases with their texts.  Only phrases that no order of equals could
    put behind the last place get their words from the dictionary."""
    order = [F.desc("score"), F.desc("a")]
    near = scores.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank")
    at = lambda i: F.conv(F.hex(F.expr(f"substring(key, {4 * i + 1}, 4)")), 16, 10).cast("long")
    asked = near.select("key", F.posexplode(F.array(*map(at, range(LONGEST)))).alias("place", "id")).filter("id > 0")
    spelled = asked.join(words.select("id", F.col("word").cast("string").alias("word")), "id").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    named = near.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    return named.filter(F.col("rank") <= top).join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``docs`` (text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the two sides of its weakest cut, ``n`` all words of
    the language.  A null lang is ``und``; a null or empty text has no words.  Texts may be of any
    length: they are cut into words a batch at a time, and a word may be as long as its text.
    Repeated rows count as often as they stand; other columns are ignored; no documents give no
    rows.  Equal scores go by ``a``, then by the phrase's UTF-8 bytes.

    Hashes of two words may be equal: the dictionary shows that for frequent words, and the sum of
    all encoded words, which must be that of the dictionary, for others.  Another salt is then taken.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for salt in range(8):
        counts = stored(word_counts(texts, least, salt), "counts")
        words = counts.filter("word is not null")
        facts = words.agg(F.count("*").alias("words"), F.count_distinct("hash").alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if facts["words"] != facts["hashes"]:
            continue
        dictionary = numbered(words)
        blocks = encode_documents(texts, dictionary, facts["words"], salt)
        if (blocks.agg(F.sum("n_tokens")).first()[0] or 0) == facts["n"]:
            break
    else:
        raise ValueError("words have equal hashes under every salt")
    pairs = stored(frequent(blocks, (2,), least), "pairs")
    known = bloom.twice_seen(pairs.select("key"), lambda batch: np.repeat(pair_hashes(_key_rows(batch.column(0))), 2), bloom.filter_bits(pairs.count()))
    longer = stored(frequent(blocks, (3, 4), least, known), "longer")
    discard(blocks)
    totals = counts.filter("word is null").select("lang", "n")
    return ranked(scored(pairs.unionByName(longer), dictionary), dictionary, totals, top)


#: The same by n-grams as text.
ORACLE = """
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^ \\t]+') AS w FROM documents),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, k, a, c, array_to_string(w[:c], ' ') AS p, array_to_string(w[c + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scores AS (SELECT x.lang, x.phrase, x.k, x.a, c, y.f AS l, z.f AS r, (CAST(2000000 AS HUGEINT) * x.a) // (y.f + z.f) AS score FROM cuts x JOIN counted y ON x.lang = y.lang AND x.p = y.phrase JOIN counted z ON x.lang = z.lang AND x.q = z.phrase),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = b.lang AND d.k > b.k AND 100 * d.a >= 80 * b.a AND contains(' ' || d.phrase || ' ', ' ' || b.phrase || ' '))),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM placed p JOIN totals t ON p.lang = t.lang WHERE rank <= 2000
"""
