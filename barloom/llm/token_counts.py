"""Token counts of sections, by offset-mapped attribution.

A document is encoded once, as a whole; its tokens' spans are then joined with the spans of its
sections.  Encoding sections apart would count other tokens, because merges and leading spaces
cross their edges.  A token that crosses an edge is allocated by an explicit rule.

Byte-level tokens cover a text without gaps, so the number of bytes that each id stands for maps
ids to offsets: a running sum gives every token's span.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from barloom.llm.common import map_batches, utf8
from barloom.llm.tokenfile import byte_encoder

#: What happens to a token that crosses the edge of two sections: it counts where it starts, where
#: it ends, or where most of its characters are (the earlier section, if as many are in each).
RULES = ("start", "end", "majority")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """The number of bytes that each id of a byte-level vocabulary stands for.

    Such a vocabulary writes a token with one character for each byte; added tokens stand as they are.
    """
    library = Tokenizer.from_file(path)
    out = np.zeros(max(library.get_vocab().values()) + 1, np.int64)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in library.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


def characters(part: bytes) -> int:
    """Characters of which a piece of UTF-8 has at least one byte."""
    return sum(b & 0xC0 != 0x80 for b in part) + (part[0] & 0xC0 == 0x80)


def majority(data: bytes, start: int, end: int) -> int:
    """Which of the lines that the bytes from start to end touch has most of their characters."""
    parts = data[start:end].split(b"\n")
    sizes = [characters(p + b"\n") for p in parts[:-1]] + ([characters(parts[-1])] if parts[-1] else [])
    return sizes.index(max(sizes))


def allocate(texts: list[bytes], ids: list[np.ndarray], lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of the token spans of a batch of texts with the spans of their lines: where
    each text's sections begin in the third array (and, last, its end), how many tokens of each
    text cross an edge, and the tokens of each section.  Each token counts once.
    """
    data = b"".join(texts)
    n_tokens = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(lengths[np.concatenate([*ids, np.zeros(0, np.uint16)])])
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    newlines = np.frombuffer(data, np.uint8) == 10
    before = np.concatenate([[0], np.cumsum(newlines)])  # newlines before each byte
    at = np.array([0, *accumulate(map(len, texts))], np.int64)
    lines = np.diff(before[at])
    n_sections = np.maximum(1, lines + np.array([not t.endswith(b"\n") for t in texts], np.int64))
    base = np.concatenate([[0], np.cumsum(n_sections)])
    text = np.repeat(np.arange(len(texts)), n_tokens)
    shift = (base[:-1] - before[at[:-1]])[text]
    first, last = before[starts] + shift, before[ends - 1] + shift
    crossing = np.flatnonzero(last > first)
    owner = last if rule == "end" else first
    if rule == "majority":
        for i in crossing:
            owner[i] += majority(data, starts[i], ends[i])
    return base, np.bincount(text[crossing], minlength=len(texts)), np.bincount(owner, minlength=base[-1])


def section_token_counts(docs: DataFrame, vocabulary: str, rule: str = "majority") -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_tokens, n_sections, n_crossing, section_tokens.

    Sections are lines, each with its newline; ``section_tokens`` has the tokens of each in order
    and adds up to ``n_tokens``.  A null or empty text is one section without tokens.  Texts may
    be of any length.  Repeated rows give repeated results; other columns are ignored; no
    documents give no rows.  A vocabulary that is not plain byte-level, as one with a normalizer, is an
    error when a row is read: its tokens would not cover the text.  No shuffle; a task holds one batch.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, texts = byte_encoder(vocabulary), utf8(batch.column(1))
        ids = [np.frombuffer(x, encoder.kind) for x in encoder.encode_batch([t.decode() for t in texts])]
        base, crossing, counts = allocate(texts, ids, token_bytes(vocabulary), rule)
        columns = [
            batch.column(0),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array(np.diff(base), pa.int64()),
            pa.array(crossing, pa.int64()),
            pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(counts, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
