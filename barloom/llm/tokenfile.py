"""Token ids in Arrow files of equal-length sequences.

The corpus, in ascending doc_id order, is cut into shards; each shard is a pair of Arrow files.
``<shard>.sequences.arrow`` has record batches with the columns ``ids`` (a fixed-size list of
unsigned 16- or 32-bit ids) and ``mask`` (a fixed-size list of bits: set for a token, not for
padding, which only a shard's last sequence has).  Fixed-size lists have no offsets and batches
lie uncompressed, so a memory map gives any sequence without a copy or a parse of what precedes.
``<shard>.documents.arrow`` has the documents of the shard with their first token's place in it.
The manifest, a Parquet table, has one row a shard.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.bpe import BYTE_CHARS
from barloom.llm.common import pieces, shared_folder

SEQUENCE = 2048
#: Sequences in one record batch of a file.
BATCH_SEQUENCES = 64
#: Documents in one shard, at most; a shard also ends where its partition does.
SHARD_DOCUMENTS = 50_000

#: Text in which both libraries' patterns find the same: Latin, without very long white space.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e¡-¬®-ɏ]*")
LONG_SPACE = re.compile("\\s{1000}")

#: Fixed value: the byte-level pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a byte-level vocabulary file.

    The rank of a token is its id, if the vocabulary has the bytes and then the result of each merge
    in order.  A file of another kind, or with settings that change what a text's ids are, is an error.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not whole.get("normalizer")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or not plain or odd:
        raise ValueError(f"{path} is no plain byte-level vocabulary {odd}")
    byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    if any(len(token) > 1 for token, i in model["vocab"].items() if i < 256) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError(f"{path} doesn't number its tokens by their merges")
    return ranks


class ByteEncoder:
    """The tokenizers library's ids for texts, as bytes.

    A vocabulary whose ids are the ranks of its merges gives the same ids in tiktoken, which is twice
    as fast; it gets the texts in which both patterns surely agree.  The others, and those with an
    added token, are for the library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=byte_level_ranks(path), special_tokens={})
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.kind = np.dtype("<u4" if self.library.get_vocab_size() > 1 << 16 else "<u2")

    def _is_plain(self, text: str) -> bool:
        return bool(PLAIN.fullmatch(text)) and not LONG_SPACE.search(text) and not self.added.search(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = list(map(self._is_plain, texts))
        slow = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [(self.fast.encode_to_numpy(t, disallowed_special=()) if p else np.array(next(slow).ids)).astype(self.kind).tobytes() for t, p in zip(texts, plain)]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return ByteEncoder(path)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, local or remote."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _fixed(values: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), width)


class ShardWriter:
    """Writes one shard's two files under a name of its own; a retried task writes new ones."""

    def __init__(self, uri: str, kind: np.dtype, sequence: int):
        self.files, folder = open_folder(uri)
        self.name, self.kind, self.sequence = uuid.uuid4().hex, kind, sequence
        self.path = f"{folder}/{self.name}"
        self.files.create_dir(folder, recursive=True)
        list_of = lambda t: pa.list_(t, sequence)
        self.schema = pa.schema([("ids", list_of(pa.from_numpy_dtype(kind))), ("mask", list_of(pa.bool_()))])
        self.sink = self.files.open_output_stream(f"{self.path}.sequences.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.held, self.n_tokens = [], 0, 0
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // self.kind.itemsize)
        self.n_tokens += self.lengths[-1]
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BATCH_SEQUENCES * self.sequence * self.kind.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        unit = self.sequence if last else BATCH_SEQUENCES * self.sequence  # only the last batch is smaller
        whole = len(ids) // unit * unit
        body, rest = ids[:whole], ids[whole:]
        mask = np.ones(whole, bool)
        if last and len(rest):
            pad = np.zeros(self.sequence - len(rest), self.kind)
            body = np.concatenate([body, rest, pad])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(len(pad), bool)])
            rest = rest[:0]
        step = BATCH_SEQUENCES * self.sequence
        for i in range(0, len(body), step):
            columns = [_fixed(body[i : i + step], self.sequence), _fixed(mask[i : i + step], self.sequence)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.waiting, self.held = [rest.tobytes()], rest.nbytes

    def close(self) -> dict[str, object]:
        self._write(True)
        self.out.close()
        self.sink.close()
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        table = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "start": starts, "n_tokens": pa.array(self.lengths, pa.int64())})
        with self.files.open_output_stream(f"{self.path}.documents.arrow") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        return {"shard": self.name, "first_doc_id": self.doc_ids[0], "n_docs": len(self.doc_ids), "n_tokens": self.n_tokens}


MANIFEST = "shard string, first_doc_id long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, uri: str, vocabulary: str, end_id: int, sequence: int = SEQUENCE, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as shards under ``uri``; the manifest.

    Texts go to their place in doc_id order by one range shuffle; each partition writes its own
    shards and holds one batch and a few sequences at a time.  Null and empty texts have the end
    id alone.  Rows with a null doc_id come first.  Repeated doc_ids follow each other in text
    order.  No documents: no shards, an empty manifest.  Texts may be of any length.  ``uri`` must be shared by all executors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)
        end = np.array([end_id], encoder.kind).tobytes()
        writer, done = None, []
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(texts)):
                writer = writer or ShardWriter(uri, encoder.kind, sequence)
                writer.add(doc_id, ids + end)
                if len(writer.doc_ids) >= shard_documents:
                    done, writer = [*done, writer.close()], None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.string()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def open_shard(uri: str, shard: str) -> tuple[pa.RecordBatchFileReader, pa.Table]:
    """Reader of a shard's sequences, memory-mapped where the file is local, and its documents."""
    files, folder = open_folder(uri)
    get = (lambda p: pa.memory_map(p)) if isinstance(files, fs.LocalFileSystem) else files.open_input_file
    documents = pa.ipc.open_file(get(f"{folder}/{shard}.documents.arrow")).read_all()
    return pa.ipc.open_file(get(f"{folder}/{shard}.sequences.arrow")), documents


def sequence_at(reader: pa.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of a shard's i-th sequence: views of the mapped file."""
    batch, row = reader.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
    ids, mask = batch.column(0), batch.column(1)
    width = ids.type.list_size
    return ids.values.to_numpy(zero_copy_only=True)[row * width : (row + 1) * width], mask.values.slice(row * width, width)


def read_documents(uri: str, shard: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """doc_id, start within the shard and ids of each document, from the files."""
    reader, documents = open_shard(uri, shard)
    columns = [documents.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens")]
    held, first, batch = [], 0, 0  # held: ids from token `first` of the shard on
    size = 0
    for doc_id, start, n in zip(*columns):
        while first + size < start + n:
            values = reader.get_batch(batch).column(0).values.to_numpy(zero_copy_only=True)
            held, size, batch = [*held, values], size + len(values), batch + 1
        while held and first + len(held[0]) <= start:
            first, size = first + len(held[0]), size - len(held[0])
            held.pop(0)
        if held and start + n <= first + len(held[0]):
            yield doc_id, start, held[0][start - first : start - first + n]
        else:
            yield doc_id, start, np.concatenate(held)[start - first : start - first + n]


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """Documents of the files under ``uri``: doc_id, start (tokens of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    The shards' own counts give their places; only the manifest, one row a shard, is summed up
    in order.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    before = Window.orderBy("first_doc_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in read_documents(uri, shard)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.select("shard", F.col("base").cast("long")).repartition(spark.sparkContext.defaultParallelism * 4, "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    uri = f"{shared_folder(docs.sparkSession)}/tokens"
    write_token_files(docs, uri, vocabulary, end_id)
    return read_token_files(docs.sparkSession, uri)
