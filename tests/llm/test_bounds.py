"""Very long texts where other tests have none, odd vocabularies, and bounds in bytes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bpe, decontam, langid, nbsvm, packing, queries, repair, suffix, token_counts, tokenfile

DOCS = "doc_id long, text string"


def long_text(megabytes):
    line = " ".join(f"w{i % 977}x{i % 991}" for i in range(2000)) + ".\n"
    return line * (megabytes * 1_000_000 // len(line))


def test_encoding_of_a_very_long_text(spark):
    text = long_text(10)
    library = Tokenizer.from_file(queries.WORD_BPE)
    ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    got = bpe.round_trip(spark.createDataFrame([(1, text)], DOCS), queries.WORD_BPE).first()
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_files_and_packing_of_a_very_long_text(spark):
    text = long_text(10)
    n = len(Tokenizer.from_file(queries.BYTE_BPE).encode(text, add_special_tokens=False).ids) + 1
    docs = spark.createDataFrame([(1, text), (2, None)], DOCS)
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in tokenfile.token_file_round_trip(docs, queries.BYTE_BPE).collect()}
    assert got == {1: (0, n), 2: (n, 1)}
    pieces = packing.pack_documents(docs, queries.BYTE_BPE, 1, with_ids=False)
    assert pieces.groupBy("doc_id").agg(F.sum("length")).sort("doc_id").collect() == [(1, n), (2, 1)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_very_long_texts(spark, tmp_path, name, stage):
    rng = np.random.default_rng(0)
    unlike = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(300_000))
    rows = [(1, long_text(5), "en", "x", 1), (2, unlike, "en", "x", 2), (3, "a short one of more than a few words, which nothing repeats or copies.", "en", "x", 3), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, " ".join(unlike.split()[1000:1060]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {"quality_rules": kept & {2, 3}, "decontamination": {1, 3, 4}}.get(name, {1, 2, 3, 4})
    assert 3 in kept


def changed(tmp_path, source, **more):
    """A vocabulary file with some settings changed."""
    with open(source, encoding="utf-8") as file:
        whole = json.load(file)
    model = more.pop("model", {})
    whole |= more
    whole["model"] |= model
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(whole), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "more",
    [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"dropout": 0.1}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}],
)
def test_vocabularies_that_are_not_plain_byte_level(tmp_path, more):
    with pytest.raises(ValueError, match="no plain byte-level vocabulary"):
        tokenfile.byte_level_ranks(changed(tmp_path, queries.BYTE_BPE, **more))


def test_tokens_must_be_numbered_by_their_merges(tmp_path):
    with open(queries.BYTE_BPE, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    swapped = [merges[1], merges[0], *merges[2:]]
    with pytest.raises(ValueError, match="by their merges"):
        tokenfile.byte_level_ranks(changed(tmp_path, queries.BYTE_BPE, model={"merges": swapped}))


def test_section_counts_of_another_vocabulary_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a text")], DOCS)
    with pytest.raises(Exception, match="no plain byte-level vocabulary"):
        token_counts.section_token_counts(docs, queries.WORD_BPE).collect()


@pytest.mark.parametrize("more", [{"decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"model": {"unk_token": "a"}}])
def test_vocabularies_that_the_trie_does_not_follow(tmp_path, more):
    with pytest.raises(ValueError, match="the trie encodes as plain BPE"):
        bpe.TrieBpe(changed(tmp_path, queries.WORD_BPE, **more))


def test_both_libraries_agree():
    """Random text of letters, contractions, white space and signs, plain and not."""
    rng, encoder, library = np.random.default_rng(3), tokenfile.ByteEncoder(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    signs = [*"abcdeABC é'12 9.,!?-\n\t\r\x0b\x0cñßÿ  '", "'s", "'ll", "'T", "<|endoftext|>", "  \n", "\xa0", "\x85", "日", "ſ", "²", "½"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 120)))) for _ in range(3000)] + [" " * 5000 + "a", "\n " * 3000, "x" * 100_000]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode_batch(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_sample_in_bytes_and_repeated_labels(spark):
    rows = [(i, f"good words {i} " * 5 if i % 2 else f"bad text {i} # $ " * 5, i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, f"{DOCS}, quality int")
    size = sum(4 * len(nbsvm.features(t.encode())) for _, t, _ in rows)
    small, whole = nbsvm.fit(labelled, sample_bytes=size // 4), nbsvm.fit(labelled)
    assert not np.array_equal(small.weights, whole.weights)
    docs = labelled.select("doc_id", "text")
    right = lambda m: np.mean([r["predicted"] == r["doc_id"] % 2 for r in nbsvm.score(docs, m, 0.5).collect()])
    assert right(small) > 0.95 and right(whole) > 0.95
    labels = labelled.select("doc_id", "quality")
    twice = nbsvm.quality_scores(docs, labels.union(labels)).collect()
    assert len(twice) == 400 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in twice)


def test_exact_decontamination(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "other words altogether here now")], f"{DOCS}")
    items = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items, exact=True).collect()] == [2]


def test_other_grammars_and_costs():
    """A grammar of two states, with cheap deletions."""
    grammar = repair.Grammar(({"u": 1}, {"a": 0}), frozenset({0}))
    composition = repair.Composition(grammar, repair.Edits(delete=1, insert=5, rerole=9))
    path = repair.ShortestPath(composition)
    for role in "uuaas":
        path.add(role, "")
    assert path.finish()[:2] == (3, "DKDKD")


def test_one_string_in_very_many_classes(spark):
    """A line that each document goes on from in its own way: it goes, with what follows it in any
    earlier document too, from all but the first."""
    n, line = 40_000, "".join(f"<{i * i % 89:02d}>" for i in range(40))[:130]
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(line), F.sha2(F.col("id").cast("string"), 256)).alias("text")).repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.repeat_report(docs).select("doc_id", "n_removed").collect()}
    seen, want = set(), {0: 0}
    for d in range(n):
        tail = hashlib.sha256(str(d).encode()).hexdigest()
        shared = next(k for k in range(65) if tail[: k + 1] not in seen)
        want[d] = 130 + shared if d else 0
        seen.update(tail[:k] for k in range(1, 12))
    assert got == want


def test_languages_beyond_one_broadcast(spark, monkeypatch):
    """Wrong labels may be many: the filters then come in parts, with the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 5).cast("string")).alias("lang"))
    docs = docs.union(spark.createDataFrame([(9000, None, "en0"), (9001, "12", "en0"), (9002, "日本語", None)], docs.schema))
    read = lambda: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect())
    want = read()
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    assert read() == want and len({x for _, x, _ in want}) > 6
