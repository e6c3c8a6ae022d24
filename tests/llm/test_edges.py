"""Repeated rows, empty tables and very long texts, for every operator."""

import numpy as np
import pytest

from barloom.llm import bpe, compression, decontam, jaccard, langid, linededup, nbsvm, queries, suffix, token_counts, tokenfile

DATA = "/root/testdata/sf0.001"
BENCHMARK = [(1, "one of the items that the documents are searched for"), (2, "two words")]


def operators(spark):
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    return {
        "op1": lambda d: bpe.round_trip(d, queries.WORD_BPE),
        "op2": lambda d: token_counts.section_token_counts(d, queries.BYTE_BPE),
        "op3": lambda d: decontam.contained_items(d, items),
        "op4": lambda d: nbsvm.quality_scores(d, labels),
        "op5": compression.compression_rules,
        "op6": lambda d: tokenfile.token_file_round_trip(d, queries.BYTE_BPE),
        "op7": suffix.repeat_report,
        "op8": jaccard.near_duplicates,
        "op9": linededup.line_report,
        "op10": langid.identify,
    }


def table(spark, rows):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", "x", 1, b"y") for i, t in rows], "doc_id long, text string, lang string, digest string, n_tokens long, key binary").repartition(3)


def texts():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    some = [" ".join(rng.choice(words, 60)) + "\n" + " ".join(rng.choice(words, 30)) for _ in range(12)]
    some[3] += " " + BENCHMARK[0][1]
    return [(i, t) for i, t in enumerate([*some, None, "", "two words", some[0], some[1] + " more"])]


#: Operators whose rows depend on no other row, and those whose numbers shift with repeated ones.
@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op8", "op9", "op10"])
def test_repeated_rows(spark, name):
    run = operators(spark)[name]
    once, twice = run(table(spark, texts())), run(table(spark, texts() * 2))
    want = sorted(map(repr, once.collect()))
    got = sorted(map(repr, twice.collect()))
    assert got == (want if name == "op3" else sorted(want * 2))


def test_repeated_rows_in_token_files(spark):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in operators(spark)["op6"](table(spark, texts() * 2)).collect())
    once = {r["doc_id"]: r["n_tokens"] for r in operators(spark)["op6"](table(spark, texts())).collect()}
    assert len(got) == 2 * len(once) and all(once[d] == n for d, _, n in got)
    assert [s for _, s, _ in got] == np.cumsum([0, *(n for *_, n in got)])[:-1].tolist()


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_empty_tables(spark, name):
    assert operators(spark)[name](table(spark, texts()).limit(0)).count() == 0


@pytest.mark.parametrize("name,megabytes", [("op3", 50), ("op5", 50), ("op9", 50), ("op10", 20), ("op4", 20), ("op8", 20), ("op2", 20), ("op7", 5)])
def test_very_long_text(spark, name, megabytes):
    line = " ".join(f"w{i % 977}x{i % 991}" for i in range(2000)) + "\n"
    rows = [(1, line * (megabytes * 1_000_000 // len(line))), (2, BENCHMARK[0][1] + " and more"), (3, None)]
    got = {r["doc_id"]: r for r in operators(spark)[name](table(spark, rows)).collect()}
    assert got.keys() == ({2} if name == "op3" else {1, 2, 3})
    if name == "op5":
        assert got[1]["n_words"] == len(rows[0][1].split()) and not got[1]["kept"]
    if name == "op2":
        assert got[1]["n_tokens"] == sum(got[1]["section_tokens"]) and got[1]["n_sections"] == rows[0][1].count("\n")
    if name == "op7":
        assert got[1]["n_removed"] > 0.9 * len(rows[0][1])


@pytest.mark.parametrize("exact", [False, True])
def test_recall_of_items_by_size(spark, exact):
    """Items of 1 to 60 shingles, each in the midst of a long document, whole and with a lost end."""
    sizes = [1, 2, 3, 8, 9, 12, 20, 60]
    words = lambda i, n: [f"i{i}w{j}" for j in range(n + 4)]
    filler = lambda d: [f"d{d}f{j}" for j in range(900)]
    items = [(i, " ".join(words(i, sizes[i % 8]))) for i in range(240)]
    docs, want = [], set()
    for i, text in items:
        n = sizes[i % 8]
        lost = n // 5 if i % 16 >= 8 else 0
        docs.append((i, " ".join(filler(i) + text.split()[lost:] + filler(-i - 1))))
        want.add((i, i, n, n - lost))
    got = decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), exact=exact)
    assert {tuple(r) for r in got.collect()} == want
