"""Packing of examples into training sequences, as vector bin packing.

A sequence has room for so many tokens, so many segments and so many tokens that bear loss, all at
once.  An example, or what is left of it, is a vector of the three.  Each task holds a bounded
window of examples and fills one sequence at a time: of the examples that fit, it places the one
whose vector has the largest dot product with the room that is left, both in parts of the limits,
so that large and balanced examples go first and small ones fill the gaps.  When none fits, the
best one is cut to the room that is left, and the rest goes back to the window.  So a sequence is
full, unless it runs out of segments or loss, or the task runs out of examples; such a sequence is
cut at the largest power of two, where it needs no padding, and what is beyond goes back to the
window.

Tasks pack apart from each other: no shuffle, and no state beyond a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import pieces
from barloom.llm.tokenfile import byte_encoder

#: Examples that a task chooses from.
WINDOW = 256
#: Pieces in one batch of the result.
PIECES = 8192


@dataclass(frozen=True)
class Limits:
    """What one sequence has room for."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("a sequence needs room for one token, one segment and one token with loss")


@dataclass
class Example:
    """The tokens of an example from ``start`` to ``end``.  ``bears`` counts the tokens with loss
    before each token and at the end; None: all bear loss but a piece's first, which nothing predicts."""

    doc_id: int | None
    ids: np.ndarray
    bears: np.ndarray | None = None
    start: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        if self.end is None:
            self.end = len(self.ids)

    def left(self) -> int:
        return self.end - self.start

    def fitting(self, tokens: int, loss: int) -> int:
        """Tokens from ``start`` on that fit into both limits."""
        n = min(tokens, self.left())
        if self.bears is None:
            return min(n, loss + 1)
        return min(n, int(np.searchsorted(self.bears, self.bears[self.start] + loss, "right")) - 1 - self.start)


def piece_loss(example: Example, start: int, n: int) -> int:
    return n - 1 if example.bears is None else int(example.bears[start + n] - example.bears[start])


Piece = tuple[Example, int, int]  # the example, the first token and the number of tokens


class Window:
    """Examples to choose from, with their vectors as arrays; each is one segment."""

    def __init__(self, source: Iterator[Example], limits: Limits, size: int = WINDOW):
        self.source, self.limits = source, limits
        self.rows: list[Example | None] = [None] * size
        self.tokens, self.loss = np.full(size, np.inf), np.zeros(size)
        self.free: list[int] = []
        self.returned: list[Example] = []
        for i in range(size):
            self.refill(i)

    def put(self, i: int, example: Example | None) -> None:
        self.rows[i] = example
        self.tokens[i], self.loss[i] = (np.inf, 0) if example is None else (n := example.left(), piece_loss(example, example.start, n))

    def refill(self, i: int) -> None:
        """Put an example that came back, or a new one, in the place of one that is used up."""
        example = self.returned.pop() if self.returned else next(self.source, None)
        self.put(i, example)
        if example is None:
            self.free.append(i)

    def give_back(self, pieces_: list[Piece]) -> None:
        self.returned += [Example(e.doc_id, e.ids, e.bears, start, start + n) for e, start, n in pieces_]
        while self.returned and self.free:
            self.put(self.free.pop(), self.returned.pop())

    def best(self, tokens: int, segments: int, loss: int) -> tuple[int, int] | None:
        """The example with the largest dot product with the room that is left, of those that fit,
        and its tokens; if none fits, the best to cut, and how much of it fits."""
        limits = self.limits
        by_token, by_loss, by_segment = tokens / limits.tokens**2, loss / limits.loss**2, segments / limits.segments**2
        product = self.tokens * by_token + self.loss * by_loss + by_segment
        product[(self.tokens > tokens) | (self.loss > loss)] = -1.0
        i = int(product.argmax())
        if product[i] >= 0:
            return i, int(self.tokens[i])
        # an example that must be cut counts for what the room can take of it
        product = np.minimum(self.tokens, tokens) * by_token + np.minimum(self.loss, loss) * by_loss
        product[np.isinf(self.tokens)] = -1.0
        i = int(product.argmax())
        n = self.rows[i].fitting(tokens, loss) if product[i] >= 0 else 0
        return (i, n) if n else None


def filled(window: Window) -> list[Piece]:
    """The pieces of the next sequence; none when there are no examples left."""
    out: list[Piece] = []
    tokens, segments, loss = window.limits.tokens, window.limits.segments, window.limits.loss
    while tokens and segments and (found := window.best(tokens, segments, loss)):
        i, n = found
        example = window.rows[i]
        out.append((example, example.start, n))
        tokens, segments, loss = tokens - n, segments - 1, loss - piece_loss(example, example.start, n)
        example.start += n
        if example.left():
            window.put(i, example)
        else:
            window.refill(i)
    return out


def cut_at(sequence: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The sequence's first ``size`` tokens, and the rest."""
    head, tail = [], []
    for example, start, n in sequence:
        take = min(n, size)
        size -= take
        head += [(example, start, take)] * (take > 0)
        tail += [(example, start + take, n - take)] * (take < n)
    return head, tail


def packed_sequences(examples: Iterator[Example], limits: Limits, window: int = WINDOW) -> Iterator[list[Piece]]:
    """Sequences of pieces; each token of each example is in exactly one."""

    def shorter() -> Iterator[Example]:
        for example in examples:
            if example.left():
                yield example

    open_ = Window(shorter(), limits, window)
    while sequence := filled(open_):
        n = sum(n for *_, n in sequence)
        if n < limits.tokens:
            sequence, rest = cut_at(sequence, 1 << (n.bit_length() - 1))
            open_.give_back(rest)
        yield sequence


PIECE = "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(sequences: Iterable[list[Piece]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces as rows.  Sequences are numbered within the partition, whose number stands in front."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    rows, ids = [], []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    for k, sequence in enumerate(sequences):
        offset = 0
        for example, start, n in sequence:
            data = example.ids[start : start + n].astype("<u4").tobytes()
            rows.append((example.doc_id, start, n, piece_loss(example, start, n), zlib.crc32(data), len(example.ids), first + k, offset))
            if with_ids:
                ids.append(data)
            offset += n
        if len(rows) >= PIECES:
            yield batch()
            rows, ids = [], []
    if rows:
        yield batch()


def _packed(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Example]], limits: Limits, with_ids: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = (example for batch in pieces(batches) for example in read(batch))
        yield from _rows(packed_sequences(examples, limits), with_ids)

    return rows.mapInArrow(run, PIECE + ", ids binary" * with_ids)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack token ids: ``examples`` (doc_id, ids array<int>, bears_loss array<boolean>) to pieces.

    ``bears_loss`` marks the tokens that bear loss, as the answers of instruction data; a null
    means all but the first of each piece.  The result has doc_id, start, length, loss_tokens,
    ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit); a sequence
    is its pieces by offset.  Null or empty ids give no piece.  Repeated rows are packed each;
    examples may be of any length; other columns are ignored; no examples give no rows.  A mask of
    another length than the ids is an error.
    """

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        for doc_id, ids, bears in zip(*(c.to_pylist() for c in batch.columns)):
            if bears is not None and len(bears) != len(ids or ()):
                raise ValueError(f"{len(bears)} marks for {len(ids or ())} ids of {doc_id}")
            yield Example(doc_id, np.array(ids or (), np.uint32), None if bears is None else np.concatenate([[0], np.cumsum(np.array(bears, bool))]))

    return _packed(examples.select("doc_id", "ids", "bears_loss"), read, limits, True)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Encode ``docs`` (doc_id, text), end each with ``end_id``, and pack them like ``pack_examples``.

    A null or empty text is its end id alone.  Texts may be of any length.  ``with_ids`` False
    leaves the column ids out.
    """

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        encoder = byte_encoder(vocabulary)
        end = np.array([end_id], encoder.kind).tobytes()
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()])):
            yield Example(doc_id, np.frombuffer(ids + end, encoder.kind))

    return _packed(docs.select("doc_id", "text"), read, limits, with_ids)


def padding(pieces_: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: sequences, tokens, padding (of sequences whose length is no power of two) and pieces."""
    lengths = pieces_.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return lengths.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(limits.tokens - F.col("n"))).alias("padding"), F.sum("k").alias("pieces")
    )
