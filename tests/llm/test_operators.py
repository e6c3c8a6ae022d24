"""Corpus operators against brute force, the library and small edge cases."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bloom, bpe, compression, decontam, jaccard, langid, linededup, nbsvm, queries, suffix, token_counts, tokenfile
from barloom.llm.common import shingle_hashes, word_hashes, words_of
from barloom.llm.components import components

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "one two three", "  double  spaces   here ", "日本語 テスト é 😀", "<|endoftext|>it's<|startoftext|> 's 12345 !!!", "x" * 5000, "ab " * 3000, "tab\tand\nlines\r\n\n end"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a row without an id")], "doc_id long, text string")
    return real.union(odd).withColumns({"digest": F.lit("clash"), "component": F.lit(1), "key": F.lit(2)}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- encoding


def test_bpe_equals_the_library(docs, rows):
    library = Tokenizer.from_file(queries.WORD_BPE)
    got = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(docs, queries.WORD_BPE), queries.WORD_BPE).collect()}
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[doc_id]["ids"], "<u4").tolist() == ids
        assert got[doc_id]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_random_words_and_small_caches(monkeypatch):
    library, rng = Tokenizer.from_file(queries.WORD_BPE), np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aabcdeno'é1 \n日"), 200)) for _ in range(100)]
    monkeypatch.setattr(bpe, "TRIE_NODES", 50)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    encoder = bpe.TrieBpe(queries.WORD_BPE)
    for i in range(0, 100, 10):
        for text, ids in zip(texts[i : i + 10], encoder.encode_batch(texts[i : i + 10])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    some = docs.filter("doc_id is not null")
    tokenfile.write_token_files(some, f"{tmp_path}/t", queries.BYTE_BPE, 2, sequence=64, shard_documents=40)
    got = {r["doc_id"]: r for r in tokenfile.read_token_files(spark, f"{tmp_path}/t").collect()}
    start = 0
    for doc_id, text in sorted(r for r in rows if r[0] is not None):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = spark.read.parquet(f"{tmp_path}/t/manifest").orderBy("first_doc_id").first()
    reader, documents = tokenfile.open_shard(f"{tmp_path}/t", shard["shard"])
    ids, mask = tokenfile.sequence_at(reader, 1)
    assert len(ids) == len(mask) == 64 and all(mask.to_pylist()) and documents.num_rows == shard["n_docs"]
    last = -(-shard["n_tokens"] // 64) - 1
    assert sum(tokenfile.sequence_at(reader, last)[1].to_pylist()) == (shard["n_tokens"] - 1) % 64 + 1


def test_token_files_of_nothing(spark):
    assert tokenfile.token_file_round_trip(empty(spark), queries.BYTE_BPE).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_token_counts(docs, rows, rule):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    got = {r["doc_id"]: r for r in token_counts.section_token_counts(docs, queries.BYTE_BPE, rule).collect()}
    for doc_id, text in rows:
        parts = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        edges = np.cumsum([0, *map(len, parts)])
        want = [0] * len(parts)
        for a, b in library.encode(text, add_special_tokens=False).offsets:
            shares = [max(0, min(b, edges[i + 1]) - max(a, edges[i])) for i in range(len(parts))]
            touched = [i for i, s in enumerate(shares) if s] or [int(np.searchsorted(edges, a, "right")) - 1]
            want[{"start": touched[0], "end": touched[-1], "majority": max(touched, key=lambda i: (shares[i], -i))}[rule]] += 1
        assert got[doc_id]["section_tokens"] == want
        assert got[doc_id]["n_tokens"] == sum(want)


def test_unknown_rule(docs):
    with pytest.raises(ValueError):
        token_counts.section_token_counts(docs, queries.BYTE_BPE, "half")


# --- quality, language


def test_base_counts(docs, rows):
    got = {r["doc_id"]: r for r in compression.compression_rules(docs).collect()}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(got[doc_id][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and got[doc_id]["kept"])


def test_bands_reject_noise_and_repetition(spark):
    rng = np.random.default_rng(0)
    noise = " ".join(base64.b64encode(rng.bytes(48)).decode() for _ in range(60))
    prose = " ".join(rng.choice("the of and to in is was for that with as on be by this are from or an at".split(), 400)) + " " + " ".join(map(str, range(3000, 3100)))
    mixed = prose + " " + " ".join(f"{w} {i % 2}" for i, w in enumerate(["word"] * 9000))
    got = {r["doc_id"]: r["kept"] for r in compression.compression_rules(spark.createDataFrame([(1, noise), (2, prose), (3, mixed)], "doc_id long, text string")).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert compression.compression_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [200, 400, 600, 1000, 2000])
def test_bands_of_short_texts(docs, size):
    rng = np.random.default_rng(size)
    for width in (w for w in (8, 12, 16, 20, 40) if 10 * (w + 1) <= size):
        noise = [base64.b64encode(rng.bytes(size)) for _ in range(50)]
        noise = [b" ".join(b[i : i + width] for i in range(0, size, width))[:size] for b in noise]
        got = compression.verdicts([None] * 50, noise)
        assert not any(r[6] or r[7] for r in got)  # rejected by the bands, not by the base rules
    texts = [r["text"].encode() for r in docs.filter(F.octet_length("text") >= size).select("text").collect()]
    prose = [t[:size].decode(errors="ignore").encode() for t in texts]
    got = [r for r in compression.verdicts([None] * len(prose), prose) if not r[6]]
    assert sum(r[7] for r in got) > 20
    assert not [r for r in got if not r[7] and r[8] > 0.5]


def test_language_filters(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = spark.createDataFrame([(i, t, "en") for i, t in enumerate([None, "", "12 !!", "the"])], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(odd).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bit_slices_name_all_languages():
    f = langid.Filters([f"l{i:03d}" for i in range(70)])
    a, b = langid.trigrams("abcdef"), langid.trigrams("uvwxyz")
    for i in (0, 69):
        f.add(i, a)
    f.add(5, b)
    counts = f.counts(a, np.array([0]), np.array([len(a)]))[0]
    assert set(np.flatnonzero(counts > 4)) == {0, 69}


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = nbsvm.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.9
    one = nbsvm.quality_scores(docs.limit(20), labels.withColumn("quality", F.lit(1)))
    assert {r["predicted"] for r in one.collect()} == {1}
    none = nbsvm.quality_scores(docs.limit(20), labels.limit(0))
    assert {round(r["score"], 3) for r in none.collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rows = [(np.array([i % 3]), np.array([1.0])) for i in range(30)]
    y = np.array([1.0 if i % 3 == 0 else -1.0 for i in range(30)])
    w = nbsvm.dual_coordinate_descent(rows, y, cost=10.0)
    assert all(np.sign(w[at] @ v + w[-1]) == label for (at, v), label in zip(rows, y))


# --- duplicates


def test_twice_seen_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 5000)
    df = spark.createDataFrame([(int(x),) for x in [*h, *h[:500]]], "h long").repartition(7)
    seen = bloom.twice_seen(df, lambda batch: batch.column(0).to_numpy().astype(np.uint64), bloom.filter_bits(5500)).value
    assert bloom.contains(seen, h[:500].astype(np.uint64)).all()
    assert bloom.contains(seen, h[500:].astype(np.uint64)).mean() < 0.05


def brute_lines(rows):
    held = defaultdict(set)
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})
    for doc_id, text in rows:
        for line in text.split("\n"):
            held[key(line)].add(doc_id)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    return {d: [x for x in t.split("\n") if gone.get(key(x), d) == d] for d, t in rows}


def test_line_dedup(spark, docs, rows):
    line = "A line that is rather long, Ünïcode too"
    extra = [(20_000 + i, f"  {line if i % 2 else line.lower()}\t\nown line of {i}\n{line}") for i in range(6)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).filter("doc_id is not null")
    known = [r for r in rows if r[0] is not None] + extra
    want = brute_lines([(d, t.replace("A line", "a line") if d >= 20_000 else t) for d, t in known])
    got = {r["doc_id"]: r for r in linededup.line_report(both).collect()}
    for doc_id, text in known:
        assert got[doc_id]["n_lines"] == text.count("\n") + 1
        assert got[doc_id]["n_dropped"] == text.count("\n") + 1 - len(want[doc_id])
    for doc_id, text in rows:
        if doc_id is not None:
            assert got[doc_id]["kept_sha256"] == hashlib.sha256("\n".join(want[doc_id]).encode()).hexdigest()
    again = linededup.line_report(both.union(both))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, [*got.values(), *got.values()]))


def test_line_dedup_edges(spark):
    odd = spark.createDataFrame([(None, "a line of some twenty letters")] * 4 + [(1, None), (2, "")], "doc_id long, text string")
    assert {(r["n_lines"], r["n_dropped"]) for r in linededup.line_report(odd).collect()} == {(1, 0)}
    assert linededup.line_report(empty(spark)).count() == 0


def brute_groups(rows):
    sets = {d: set(shingle_hashes(word_hashes(words_of(t.encode()))).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(n, words=60, seed=0, edits=3):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            copy[at] = f"edit{i}x{at}"
        out.append((30_000 + i, " ".join(copy)))
    return out


def test_near_duplicates(spark, docs, rows):
    extra = near_copies(60)
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_groups([r for r in rows if r[0] is not None] + extra)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(both).collect() if r["doc_id"] is not None}
    assert got == want


@pytest.mark.parametrize("hubs,sample,edits", [(0, 8, 3), (1, 1, 3), (6, 1, 5), (2, 2, 5)])
def test_near_duplicates_by_other_routes(spark, monkeypatch, hubs, sample, edits):
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard, "LIST_SAMPLE", sample)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    monkeypatch.setattr(jaccard, "CANDIDATES", 7)
    rows = near_copies(50, 40 if edits == 3 else 120, hubs, edits) + [(i, t) for i, t in enumerate([None, "", "a b", "A B", "a b c"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups([(d, t or "") for d, t in rows])
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_a_doc_id_with_two_texts(spark):
    text = lambda name, last: " ".join([f"{name}{i}" for i in range(60)] + [last])
    rows = [(1, text("a", "x")), (1, text("b", "x")), (2, text("a", "y")), (3, text("b", "y")), (4, text("c", "x"))]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(50):
        query = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        others = [np.unique(np.concatenate([rng.choice(query, 30), rng.integers(0, 80, 4).astype(np.uint64)])) for _ in range(12)]
        want = [180 * len(set(query) & set(o)) >= 80 * (len(query) + len(o)) for o in others]
        assert jaccard.divide_skip(query, jaccard.Lists(others)) == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[doc_id] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowded", [suffix.CROWDED, 1])
def test_repeated_strings(spark, docs, rows, crowded):
    passage = " ".join(f"word{i}" for i in range(40))
    extra = [(40_000 + i, f"{i} before {passage[: 120 + 3 * i]} after {i}\n" * (1 + i % 2)) for i in range(30)] + [(41_000, "abc" * 200), (41_001, "z" * 99), (41_002, "z" * 250)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_repeats([r for r in rows if r[0] is not None] + extra)
    cut = suffix.remove_repeats(both, crowded).filter("doc_id is not null")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in cut.collect()}
    assert got == want


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "abcdefgh" * 40), (1, "abcdefgh" * 40), (1, "other " * 50), (None, "abcdefgh" * 40)], "doc_id long, text string")
    assert suffix.repeat_report(df).count() == 4
    assert suffix.repeat_report(empty(spark)).count() == 0


def test_levels_stay_few():
    levels, rng = suffix.Levels(), np.random.default_rng(0)
    seen = set()
    for _ in range(40):
        words = [b"%0100d" % x for x in rng.integers(0, 3000, 100)]
        flags = levels.add(np.frombuffer(b"".join(words), np.uint8), np.arange(0, 10_000, 100))
        for s, again in zip(words, flags):
            assert again == (s in seen)
            seen.add(s)
    assert len(levels.levels) <= 8
    for level in levels.levels:
        assert level.strings().tolist() == sorted(level.strings().tolist())


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 300), np.zeros(150, np.int64), rng.integers(97, 99, 300)]).astype(np.uint8)
    text[400:600] = text[100:300]
    places = np.arange(len(text) - 99)
    array, equal = suffix.suffix_array(text, places)
    strings = [text[p : p + 100].tobytes() for p in array.places]
    assert strings == sorted(strings) and sorted(array.places) == places.tolist()
    assert equal.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


@pytest.mark.parametrize("before", [65_480, 32_700, 200_000])
def test_repeats_in_very_long_texts(spark, before):
    rng = np.random.default_rng(before)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    one = noise(before) + "=-" * 70 + noise(300)
    many = noise(40_000) + one[before - 500 : before + 300] + "é" * 200 + noise(70_000) + one[100:400] + "z" * 66_000
    rows = [(1, one), (2, many), (3, "=-" * 60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_contained_items(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [(900, "a b c"), (901, None), (902, "x y z w v u t"), (903, "x y z w v u t")]
    extra = [(50_000, "far " * 3000 + items[0][1] + " away" * 3000), (50_001, "a b c"), (50_002, " ".join(f"n{i}" for i in range(50)) + " X Y z W v u t")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    shingles = lambda t: set(shingle_hashes(word_hashes(words_of((t or "").encode()))).tolist())
    known = [(d, shingles(t)) for d, t in [r for r in rows if r[0] is not None] + extra]
    want = {(d, i, len(q), len(s & q)) for i, t in items if (q := shingles(t)) for d, s in known if 100 * len(s & q) >= 80 * len(q)}
    got = {tuple(r) for r in decontam.contained_items(both, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert decontam.contained_items(both, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contained_items(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("only_short", [True, False])
def test_short_items_are_never_missed(spark, only_short):
    words = lambda i, n: [f"i{i}w{j}" for j in range(n)]
    items = [(i, " ".join(words(i, 1 + i % 12))) for i in range(2400)] + [(9000, " ".join(words(9000, 30)))] * (not only_short)
    filler = lambda d: [f"d{d}f{j}" for j in range(150)]
    docs = [(i, " ".join(filler(i) + words(i, 1 + i % 12) + filler(-i))) for i in range(2400) if i % 12 > 3] + [(i, " ".join(words(i, 1 + i % 12))) for i in range(2400) if i % 12 <= 3]
    # one of eight shingles is lost, then one of five, then two of six, which is too much
    broken = [(5000, words(11, 12)[:11]), (5001, words(8, 9)[1:]), (5002, words(9, 10)[:8])]
    docs += [(d, " ".join(filler(d) + w)) for d, w in broken]
    got = {tuple(r) for r in decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    n = lambda i: max(1, i % 12 - 3)
    assert got == {(i, i, n(i), n(i)) for i in range(2400)} | {(5000, 11, 8, 7), (5001, 8, 5, 4)}


def test_very_long_items(spark):
    text = lambda a, n: " ".join(f"w{a + j}" for j in range(n))
    items = [(1, text(0, 3000)), (2, text(100_000, 20_000)), (3, text(900_000, 4000))]
    docs = [(10, text(500_000, 5000) + " " + text(0, 3000) + " " + text(600_000, 5000)), (11, text(100_000, 17_000)), (12, text(0, 2000)), (13, text(900_000, 3990))]
    got = {tuple(r) for r in decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10, 1, 2996, 2996), (11, 2, 19_996, 16_996), (13, 3, 3996, 3986)}


# --- pipeline


def test_pipeline(spark):
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in raw.collect()]
    kept = {r["doc_id"] for r in compression.compression_rules(raw).collect() if r["kept"]}
    cut = {d: "\n".join(x) for d, x in brute_lines([r for r in rows if r[0] in kept]).items()}
    groups = brute_groups(list(cut.items()))
    one = {d: t for d, t in cut.items() if groups[d][1] == d}
    shingles = lambda t: set(shingle_hashes(word_hashes(words_of(t.encode()))).tolist())
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {d: t for d, t in one.items() if not any(100 * len(shingles(t) & q) >= 80 * len(q) for q in items)}
    library = Tokenizer.from_file(queries.WORD_BPE)
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in clean.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    from barloom.llm.common import shared_folder

    assert os.path.isabs(shared_folder(spark).removeprefix("file:"))
