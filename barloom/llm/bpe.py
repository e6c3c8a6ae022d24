"""BPE encoding and decoding by prefix-sharing trie traversal.

The words of a batch go into a trie whose nodes stand for word prefixes.  A node's state is the
last token of its prefix's encoding.  It follows from the states above it: of the vocabulary
tokens that end at the node, it is the longest one which BPE would leave standing after the last
token of the prefix before it.  Going through the trie depth first, each shared prefix is encoded
once; a word's ids are read off by following the tokens back to the root.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from barloom.llm.common import CACHE_ENTRIES, map_batches

#: Trie nodes that a worker keeps before it starts a new trie.
TRIE_NODES = 400_000
#: Longer words pass through the same states without getting nodes of their own.
TRIE_DEPTH = 48

#: Latin characters on which Python and the tokenizer's Unicode tables agree, and those of them
#: that are letters or digits.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e¡-¬®-įı-ɏ]*")
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"

#: The normalizer and pre-tokenizer for which the patterns above hold.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PRETOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTE_CHARS = byte_chars()


class Trie:
    """Word prefixes with the last token of each one's encoding."""

    def __init__(self, merges: "Merges"):
        self.merges = merges
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        self.ends: dict[int, list[str]] = {}  # words to encode, by the node where they end
        self.open: set[int] = set()  # those nodes and all above them

    def insert(self, word: str) -> None:
        """The end of a word has tokens of its own where the model marks ends; its last character
        is then no node. Characters beyond TRIE_DEPTH get no nodes either."""
        node, path = 0, [0]
        for ch in (word[:-1] if self.merges.suffix else word)[:TRIE_DEPTH]:
            below = self.children[node]
            node = below.get(ch, -1)
            if node < 0:
                node = below[ch] = len(self.children)
                self.children.append({})
                self.token.append(-1)
            path.append(node)
        self.ends.setdefault(node, []).append(word)
        self.open.update(path)

    def encode(self) -> dict[str, list[int]]:
        """Go depth first to all words inserted since the last call; their ids."""
        m, path, last, out = self.merges, [], [], {}
        stack = [(0, "", 0)]
        while stack:
            node, ch, depth = stack.pop()
            if depth:
                del path[depth - 1 :], last[depth - 1 :]
                path.append(ch)
                if self.token[node] < 0:
                    self.token[node] = m.last_token("".join(path), last, "")
                last.append(self.token[node])
            for word in self.ends.get(node, ()):
                out[word] = m.read(word, last)
            stack.extend((n, c, depth + 1) for c, n in self.children[node].items() if n in self.open)
        self.open.clear()
        self.ends.clear()
        return out


class Merges:
    """Vocabulary and merge ranks of a BPE model, and which tokens may follow each other."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # token -> rank of the merge that makes it
        for rank, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.rank[left, right] = rank
            self.parts[whole] = (left, right)
            self.made[whole] = rank
        self.length = {i: len(t[: len(t) - len(suffix)] if suffix and t.endswith(suffix) else t) for t, i in vocab.items()}
        self.reach: dict[str, int] = {}  # length of the longest token with these four last characters
        for t, i in vocab.items():
            end = t[-4 - len(suffix) :] if suffix and t.endswith(suffix) else t[-4:]
            self.reach[end] = max(self.reach.get(end, 3), self.length[i])
        self._stands: dict[int, bool] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def _border_holds(self, left: int, right: int, before: float) -> bool:
        """No merge of a rank below ``before`` crosses the border while both sides are built.

        Undo the merges of the two sides, latest first.  What meets at the border in between
        must not have a merge of its own that comes earlier than the one just undone.
        """
        rank, made, parts = self.rank, self.made, self.parts
        limit = before
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            # of merges of one rank BPE makes the leftmost first: one at the border comes after
            # the left side's and before the right side's
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def stands(self, token: int) -> bool:
        """Whether BPE encodes the token's own text as this token."""
        if (known := self._stands.get(token)) is None:
            known = True
            if token in self.parts:
                left, right = self.parts[token]
                known = self.stands(left) and self.stands(right) and self._border_holds(left, right, self.made[token])
            self._stands[token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        if (known := self._follows.get((left, right))) is None:
            known = self._border_holds(left, right, float("inf"))
            if len(self._follows) > 2 * CACHE_ENTRIES:
                self._follows.clear()
            self._follows[left, right] = known
        return known

    def last_token(self, prefix: str, last: list[int], suffix: str) -> int:
        """Last token of the encoding of ``prefix``; ``last`` has those of all shorter prefixes."""
        n, text, vocab = len(prefix), prefix + suffix, self.vocab
        for start in range(max(0, n - self.reach.get(text[max(0, n - 4) :], 3)), n):
            if (token := vocab.get(text[start:])) is not None and self.stands(token) and (not start or self.follows(last[start - 1], token)):
                return token
        raise ValueError(f"the vocabulary lacks {prefix[-1] + suffix!r}")

    def read(self, word: str, last: list[int]) -> list[int]:
        """Ids of a word, given the last tokens of its prefixes as far as the trie has them."""
        states, marked = last[:], len(word) - bool(self.suffix)
        for i in range(len(states), marked):
            states.append(self.last_token(word[: i + 1], states, ""))
        if self.suffix:
            states.append(self.last_token(word, states, self.suffix))
        ids, at = [], len(word)
        while at:
            ids.append(states[at - 1])
            at -= self.length[states[at - 1]]
        return ids[::-1]


class TrieBpe:
    """Encoder and decoder with the vocabulary of a ``tokenizers`` file.

    The file's own normalizer and pre-tokenizer find the words; the ids come from the trie.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)] + ["decoder"] * bool(spec["decoder"])
        if model["type"] != "BPE" or odd:
            raise ValueError(f"{path}: the trie encodes as plain BPE and decodes without a decoder, not with {odd or model['type']}")
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.trie = Trie(self.merges)
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.strings = [""] * (1 + max([*model["vocab"].values(), *self.added.values()]))
        for text, i in [*model["vocab"].items(), *self.added.items()]:
            self.strings[i] = text
        self.plain_words = None
        if spec["normalizer"] == WORD_NORMALIZER and spec["pre_tokenizer"] == WORD_PRETOKENIZER:
            self.plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+").findall

    def _words(self, text: str) -> list[str]:
        """Words of a text or chunk in the vocabulary's alphabet, which writes bytes as characters."""
        if self.plain_words and PLAIN.fullmatch(text):
            words = self.plain_words(text.lower())
            return words if text.isascii() else ["".join(map(BYTE_CHARS.__getitem__, w.encode())) for w in words]
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn(self, new: set[str]) -> None:
        """Encode distinct words by one traversal of the trie."""
        if len(self.trie.children) > TRIE_NODES:
            self.trie = Trie(self.merges)
        for w in new:
            self.trie.insert(w)
        self.words.update(self.trie.encode())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        What stands between white space is encoded once and kept, within bounds.
        """
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        rows: list[list[bytes | list[str]]] = []
        new: set[str] = set()
        for text in texts:
            row: list[bytes | list[str]] = []
            for part in self.special.split(text) if self.special else [text]:
                if part in self.added:
                    row.append(np.uint32(self.added[part]).tobytes())
                else:
                    row.append(part.split() if PLAIN.fullmatch(part) else [part])
                    new.update(row[-1])
            rows.append(row)
        new -= self.chunks.keys()
        split = {x: self._words(x) for x in new}
        self._learn({w for ws in split.values() for w in ws} - self.words.keys())
        for x, ws in split.items():
            self.chunks[x] = np.array([i for w in ws for i in self.words[w]], "<u4").tobytes()
        out = [b"".join([x if type(x) is bytes else b"".join(map(self.chunks.__getitem__, x)) for x in row]) for row in rows]
        for x in new:
            if len(x) > 64:
                del self.chunks[x]
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings, joined by a space: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBpe:
    """One encoder for each vocabulary in a worker."""
    return TrieBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (binary, little-endian unsigned 32-bit).

    ``vocabulary`` is a ``tokenizers`` file that every executor can open.  Null and empty texts
    give no ids.  Other columns of ``docs`` are ignored; repeated rows give repeated results; no
    documents give no rows.  Texts may be of any length.  A vocabulary with settings that the trie
    doesn't follow is an error when a row is read.
    Needs no shuffle; a worker holds one batch, one trie and one word cache of bounded size.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = trie_bpe(vocabulary).encode_batch([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (doc_id, ids) -> doc_id, ids, decoded (string). Null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = trie_bpe(vocabulary)
        texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same functions as ``encode_documents`` and ``decode_documents``, without sending the ids
    and texts through the JVM in between.  Null and empty texts: 0 tokens, digests of nothing.  Texts
    may be of any length; no documents give no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = trie_bpe(vocabulary)
        ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
        columns = [
            batch.column(0),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
