"""Conversation repair, packing and phrase mining against brute force, and their edge cases."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import packing, phrases, queries, repair

DATA = "/root/testdata/sf0.001"

# --- conversation repair


def damage(rows):
    """The contract's faults, row by row."""
    out = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Paths in the order of (cost, labels), until one is through."""
    arcs, found = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], faults(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, labels, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, labels, hashlib.sha256("\n".join(out).encode()).hexdigest()
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in ("user", "assistant"):
            if role[0] in arcs[q]:
                heapq.heappush(heap, (cost + 3, labels + "I", i, arcs[q][role[0]], (*out, role + ":")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, q, out))
            if found[i] in ("", "truncated"):
                more = 3 * (found[i] == "truncated")
                if own[:1] in arcs[q]:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, arcs[q][own[:1]], (*out, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if role[0] in arcs[q]:
                        heapq.heappush(heap, (cost + more + 3, labels + "R", i + 1, arcs[q][role[0]], (*out, f"{role}:{text}")))


def reports(rows):
    """What repair_report should say of (conv_id, turn, role, text)."""
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    out = {}
    for conv_id, own in by_id.items():
        hurt = damage(own)
        found, turns, initials = Counter(faults(hurt)), [t for t, *_ in hurt if t is not None], [r[:1] for _, r, _ in hurt]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, digest = cheapest(hurt)
        out[conv_id] = (gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, digest)
    return out


def conversations():
    rng, rows = np.random.default_rng(5), []
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "Why? ", " ", "", None, "a\nb!", "日本。", "x" * 50 + "."]
    for conv_id in [*range(80), None]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((conv_id, None if rng.random() < 0.1 else int(turn + rng.integers(0, 2)), roles[rng.choice(6, p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])], texts[rng.integers(len(texts))]))
    return rows + rows[:20]


def spark_rows(spark, rows):
    """With columns whose names clash with those that the operator makes."""
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, fault string, place int, _again boolean").repartition(5)


def report_of(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(repair.damaged(frame)).collect()}


def test_repair_equals_brute_force(spark):
    rows = conversations()
    assert report_of(spark_rows(spark, rows)) == reports(rows)


def test_repair_of_the_table_equals_sql(spark):
    got = sorted(tuple(r) for r in queries.op11_role_grammar_repair(spark, DATA).collect())
    with duckdb.connect() as db:
        db.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
        assert got == sorted(db.sql(repair.ORACLE).fetchall())


def test_shortest_paths_of_all_short_conversations():
    composition = repair.Composition()
    kinds = [("user", "x."), ("assistant", "y."), ("system", "z."), ("tool", "t."), ("user", ""), ("assistant", "q")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            rows = [(i, role, text and f"{i}{text}") for i, (role, text) in enumerate(rows)]
            path = repair.ShortestPath(composition)
            for (_, role, _), fault in zip(rows, faults(rows)):
                path.add(role[:1], fault)
            assert path.finish()[:2] == cheapest(rows)[:2]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello"), (1, 2, "user", "Why?"), (2, 0, "assistant", "So."), (None, None, "user", "Null?")]
    kept = repair.flagged(spark_rows(spark, rows))
    audited = repair.audits(kept)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audited.collect()} == {1: (6, "KKR"), 2: (3, "IK"), None: (3, "KI")}
    got = [tuple(r) for r in repair.repaired(kept, audited).orderBy("conv_id", "place").collect()]
    assert got == [
        (None, 1, "K", "user", "Null?"), (None, 2, "I", "assistant", ""), (1, 1, "K", "system", "Be kind."), (1, 2, "K", "user", "Hello"), (1, 3, "R", "assistant", "Why?"),
        (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "So."),
    ]


def test_long_conversations_and_texts(spark):
    rows = [(7, i, "user", f"Turn {i}.") for i in range(30_000)] + [(8, 0, "user", "z" * 20_000_000 + ".")]
    got = report_of(spark_rows(spark, rows))
    assert got[7] == reports(rows[:-1])[7] and got[8] == reports(rows[-1:])[8]


def test_repair_of_nothing(spark):
    assert report_of(spark_rows(spark, []).limit(0)) == {}


def test_edits_need_costs():
    with pytest.raises(ValueError):
        repair.Edits(insert=0)


# --- packing


def check_pieces(pieces, ids_of, limits):
    """Each id in one piece, no gaps, all limits kept, all lengths powers of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == ids_of.keys()
    for doc_id, own in by_doc.items():
        at, whole = 0, ids_of[doc_id]
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(whole)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(whole[p["start"] : at], "<u4").tobytes())
        assert at == len(whole)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss
        assert at & (at - 1) == 0
    return by_sequence


def test_packing_equals_the_library(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "日本語 é 😀"), (10_003, "<|endoftext|>it's 12345"), (10_004, "word " * 40_000)], "doc_id long, text string")
    docs = real.union(odd).withColumns({"length": F.lit("clash"), "ids": F.lit(1)}).repartition(3)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    ids_of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    packed = packing.pack_documents(docs, queries.BYTE_BPE, 1)
    rows = packed.collect()
    by_sequence = check_pieces(rows, ids_of, packing.Limits())
    assert all(np.frombuffer(p["ids"], "<u4").tolist() == ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]] for p in rows)
    full = sum(sum(p["length"] for p in own) == 2048 for own in by_sequence.values())
    assert full >= sum(map(len, ids_of.values())) // 2048 - 3  # a remainder for each partition
    assert packing.padding(packed).first()["padding"] == 0


def test_packing_under_all_limits(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(400):
        n = int(rng.integers(0, 200))
        rows.append((i, rng.integers(0, 99, n).tolist(), None if i % 5 == 0 else (rng.random(n) < 0.4).tolist()))
    limits = packing.Limits(256, 5, 100)
    packed = packing.pack_examples(spark.createDataFrame(rows, "doc_id long, ids array<int>, bears_loss array<boolean>").repartition(2), limits).collect()
    check_pieces(packed, {i: ids for i, ids, _ in rows if ids}, limits)
    for p in packed:
        mask = rows[p["doc_id"]][2]
        assert p["loss_tokens"] == (p["length"] - 1 if mask is None else sum(mask[p["start"] : p["start"] + p["length"]]))


def test_large_examples_first_and_small_ones_in_gaps():
    examples = [packing.Example(i, np.zeros(n, np.uint16)) for i, n in enumerate([10, 700, 54, 1000, 284])]
    sequences = list(packing.packed_sequences(iter(examples), packing.Limits()))
    assert [e.doc_id for e, *_ in sequences[0]] == [3, 1, 4, 2, 0] and len(sequences) == 1


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 5, "doc_id long, text string")
    rows = packing.pack_documents(docs, queries.BYTE_BPE, 1, with_ids=False).collect()
    assert sum(p["length"] for p in rows) == 5 * rows[0]["doc_tokens"]
    assert packing.pack_documents(docs.limit(0), queries.BYTE_BPE, 1).count() == 0


def test_masks_and_limits_must_fit(spark):
    with pytest.raises(ValueError):
        packing.Limits(segments=0)
    wrong = spark.createDataFrame([(1, [1, 2], [True])], "doc_id long, ids array<int>, bears_loss array<boolean>")
    with pytest.raises(Exception, match="1 marks for 2 ids"):
        packing.pack_examples(wrong).collect()


# --- phrases


def collocations(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting tuples of words."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        parts = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    parts[p[i : i + k]] = max(parts[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * parts[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(8)
    words = ["of", "the", "a", "in", "new", "York", "é", "日本", "x\x01", "x", "b-c", "Zed", "<|endoftext|>"]
    some = []
    for i in range(300):
        text = "".join(f"{words[j]}{rng.choice([' ', ' ', ' ', '  ', '. ', chr(9), ', ', chr(10)])}" for j in rng.choice(len(words), 30, p=np.array([5, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1]) / 28))
        some.append((["en", "fr", None][i % 3], text + " once" + str(i) + " New York City hall, New York City"))
    return [*some, ("en", None), ("en", ""), ("fr", " . ,"), ("de", "alone")] + some[:5]


def phrase_table(spark, rows):
    return spark.createDataFrame([(i % 7, text, lang, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, word string, n int").repartition(4)


def mined(frame, *args):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.mine_phrases(frame, *args).collect())


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 40)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows()
    assert mined(phrase_table(spark, rows), least, top) == collocations(rows, least, top) != []


def test_phrases_with_small_blocks_and_a_dictionary_in_parts(spark, monkeypatch):
    """Everything that is bounded by a constant, beyond its bound."""
    rows = phrase_rows()
    want = collocations(rows, 20, 100)
    for name, value in (("BROADCAST_WORDS", 3), ("HELD_WORDS", 5), ("BLOCK_IDS", 7), ("HELD_GRAMS", 11), ("SPLIT_BYTES", 40)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(phrase_table(spark, rows), 20, 100) == want


def test_equal_hashes_are_noticed(spark, monkeypatch):
    rows, real = phrase_rows()[:60], phrases.word_hash
    monkeypatch.setattr(phrases, "_seed", lambda lang, salt: salt)
    # under the first salt a rare word has the hash of a frequent one, under the second all are equal
    monkeypatch.setattr(phrases, "word_hash", lambda word, seed: real(b"the" if seed == 0 and word == b"once3" else word, 5) if seed != 1 else 9)
    plain = [("en", text) for _, text in rows]
    assert mined(phrase_table(spark, plain), 10, 50) == collocations(plain, 10, 50)


def test_phrases_of_the_table_equal_sql(spark):
    got = sorted(tuple(r) for r in queries.op13_phrase_collocations(spark, "/root/testdata/sf0.01").collect())
    with duckdb.connect() as db:
        db.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
        assert got == sorted(db.sql(phrases.ORACLE).fetchall())


def test_long_texts_and_no_documents(spark):
    line = " ".join(f"w{i % 97} x{i % 89}" for i in range(2000)) + "\n"
    long = [("en", line * 500), ("en", "y" * 5_000_000), ("en", "z " * 2_000_000)]
    got = mined(phrase_table(spark, long), 30, 10)
    assert [r[2] for r in got][:3] != [] and got[0][6] == sum(len(t.split()) for _, t in long)
    assert ("en", "z z z z", 1_999_997) in {(r[0], r[2], r[3]) for r in mined(phrase_table(spark, long[2:]), 30, 10)}
    assert mined(phrase_table(spark, long).limit(0)) == []


def test_radix_sort():
    keys = np.random.default_rng(0).integers(0, 1 << 18, (5000, 4)).astype(np.uint32)
    keys[:, 3] = 0
    assert phrases.radix_sorted(keys).tolist() == sorted(keys.tolist())
    starts, n = phrases.run_lengths(phrases.radix_sorted(np.repeat(keys[:7], [1, 2, 3, 4, 5, 6, 7], axis=0)))
    assert sorted(n.tolist()) == [1, 2, 3, 4, 5, 6, 7] and starts[0] == 0
