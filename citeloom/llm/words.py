"""Distinct-word tables: per-chunk dictionaries, so that each distinct word is worked on once.

Documents are read in chunks of bounded size. A chunk's texts become positions in the chunk's own
dictionary. Two frames come of it, both linear in the input: the dictionaries, a row for each
(chunk, distinct word), which are dealt by word; and the chunks, a row each with the packed
positions, which meet what was found for their words again. No text is shuffled, and no table of
all words is ever in one place.

A chunk's number has its place and some bits of a digest of what it holds, so both frames number it alike if
they see the same rows; where they don't, because the input's order changed between two readings, the chunk
lacks its dictionary and the job fails instead of giving a wrong result. Inputs are to be tables, whose
order is fixed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text in a chunk. A longer text is a chunk by itself.
CHUNK_BYTES = 28_000_000

#: Partitions, and chunks of each, whose chunks make a block: at most their product of chunks. Both are powers of two.
BLOCK_PARTITIONS, BLOCK_CHUNKS = 128, 64

#: text -> its words, all of one kind (str or bytes)
Splitter = Callable[[bytes], list]


class Numbers(dict):
    """Numbers words from 0 as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def block_of(chunk: Column, partitions: int = BLOCK_PARTITIONS, chunks: int = BLOCK_CHUNKS) -> Column:
    """The block of a chunk. A word that stands in every chunk has a row for each, too many for one task; by (word, block) it has a bounded number."""
    low = chunks.bit_length() - 1
    within = F.shiftright(chunk, 16 + low).bitwiseAND((1 << 20 - low) - 1)
    return F.shiftleft(F.shiftright(chunk, 36 + partitions.bit_length() - 1), 20 - low).bitwiseOR(within)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def _read(batch: pa.RecordBatch, ordinal: int, split: Splitter) -> tuple[int, Numbers, np.ndarray, np.ndarray]:
    """Number, dictionary, words in each document and positions, of a slice with doc_id and body."""
    index = Numbers()
    digest = hashlib.blake2b(digest_size=2)
    counts, parts = [], []
    for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
        body = body.as_py() or b""
        digest.update(b"%s:%d:" % (str(doc_id).encode(), len(body)))
        digest.update(body)
        words = split(body)
        counts.append(len(words))
        parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
    number = TaskContext.get().partitionId() << 36 | ordinal << 16 | int.from_bytes(digest.digest(), "big")
    return number, index, np.array(counts, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def pack(positions: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, which compresses well."""
    return zstandard.ZstdCompressor(level=1).compress(positions.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 4 * n))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def dictionaries(docs: DataFrame, split: Splitter, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, idx int, word binary, n long, n_train long) of docs(doc_id, body binary[, train boolean]).

    ``n`` counts the word in the chunk, ``n_train`` in those documents with ``train`` (0 where there
    is no such column).
    """
    training = "train" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinal, batch in enumerate(slices(batches, "body", chunk_bytes)):
            chunk, index, counts, positions = _read(batch, ordinal, split)
            size = len(index)
            n = np.bincount(positions, minlength=size)
            if training:
                is_train = np.repeat(np.array(batch.column("train").to_pylist(), bool), counts)
                n_train = np.bincount(positions[is_train], minlength=size)
            else:
                n_train = np.zeros(size, np.int64)
            words = pa.array([w if isinstance(w, bytes) else w.encode() for w in index], pa.binary())
            del index, positions  # before the next chunk is read
            for at in range(0, size, 50_000):
                k = min(50_000, size - at)
                yield pa.record_batch(
                    [pa.array([chunk] * k, pa.int64()), pa.array(np.arange(at, at + k, dtype=np.int32)), words.slice(at, k), pa.array(n[at : at + k].astype(np.int64)), pa.array(n_train[at : at + k].astype(np.int64))],
                    names=["chunk", "idx", "word", "n", "n_train"],
                )

    return docs.mapInArrow(run, "chunk long, idx int, word binary, n long, n_train long")


def positions(docs: DataFrame, split: Splitter, extra: Callable[[pa.RecordBatch], dict] | None = None, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, size int, meta string, packed binary) of docs(doc_id, body binary, ...).

    ``meta`` is JSON of lists with an entry for each document: doc_id, n_words and what ``extra`` gives
    for the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinal, batch in enumerate(slices(batches, "body", chunk_bytes)):
            chunk, index, counts, where = _read(batch, ordinal, split)
            meta = {"doc_id": batch.column("doc_id").to_pylist(), "n_words": counts.tolist()} | (extra(batch) if extra else {})
            row = [pa.array([chunk], pa.int64()), pa.array([len(index)], pa.int32()), pa.array([json.dumps(meta)]), pa.array([pack(where)], pa.binary())]
            del index, counts, where, meta  # before the next chunk is read
            yield pa.record_batch(row, names=["chunk", "size", "meta", "packed"])

    return docs.mapInArrow(run, "chunk long, size int, meta string, packed binary")


def pack_found(chunk: np.ndarray, idx: np.ndarray, values: pa.Array) -> pa.RecordBatch:
    """(chunk, packed): the binary ``values``, whole 32-bit integers, of each chunk's words in a row."""
    order = np.lexsort((idx, chunk))
    chunk, idx, values = chunk[order], idx[order].astype(np.int64), values.take(pa.array(order))
    sizes = pc.binary_length(values).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(joined(values), "<u4")
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(chunk) else np.zeros(1, np.int64)
    rows = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        head = np.r_[j - i, np.diff(idx[i:j], prepend=0), sizes[i:j], flat[ends[i] - sizes[i] : ends[j - 1]]]
        rows.append((len(head)).to_bytes(4, "little") + pack(head))
    return pa.record_batch([pa.array(chunk[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["chunk", "packed"])


def unpack_found(rows: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Dictionary positions and values out of rows of pack_found."""
    idx, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for row in rows:
        x = unpack(row[4:], int.from_bytes(row[:4], "little"))
        n = int(x[0])
        idx.append(np.cumsum(x[1 : n + 1].astype(np.int64)))
        sizes.append(x[n + 1 : 2 * n + 1].astype(np.int64))
        flat.append(x[2 * n + 1 :])
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes)) * 4].astype(np.int32)
    data = np.concatenate(flat).astype("<u4").tobytes()
    return np.concatenate(idx), pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def joined(values: pa.Array) -> bytes:
    """The values of a binary array, one after another."""
    if not len(values):
        return b""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2])[offsets[0] : offsets[-1]].tobytes() if values.buffers()[2] is not None else b""


def rejoin(chunks: DataFrame, found: DataFrame, work: Callable[[dict, np.ndarray, pa.Array], pa.Table], schema: str) -> DataFrame:
    """Bring each chunk together with what was found for its dictionary.

    ``found`` has (chunk, packed) of pack_found or (chunk, idx, value). ``work`` gets meta, positions and the
    values in dictionary order, and returns rows of ``schema``.
    """
    packed = "packed" in found.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if packed:
            idx, values = unpack_found(right.column("packed").to_pylist())
        else:
            idx, values = right.column("idx").to_numpy(), right.column("value").combine_chunks()
        values = values.take(pa.array(np.argsort(idx)))
        tables = []
        for row in left.to_pylist():
            if row["size"] != len(idx):
                raise RuntimeError("the input gave other rows, or another order, when read again; write it as a table first")
            meta = json.loads(row["meta"])
            tables.append(work(meta, unpack(row["packed"], sum(meta["n_words"])), values))
        return pa.concat_tables(tables) if tables else empty

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)
