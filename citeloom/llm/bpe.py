"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .words import block_of, dictionaries, joined, pack, pack_found, positions, rejoin, unpack

# The code points of the Unicode property White_Space, and Latin letters (all of category L).
_SPACE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + chr(0x2028) + chr(0x2029) + chr(0x202F) + chr(0x205F) + chr(0x3000)
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Bytes of text in a chunk, fewer than elsewhere: while one is decoded, the next is put together by another worker.
CHUNK_BYTES = 20_000_000

#: Ids that a row carries, packed: rows stay small where they meet the vocabulary.
PART_IDS = 262_144

#: Pieces of a text whose ids, one after another, are those of the text: byte-level BPE with the
#: usual pattern never crosses a step from other characters to white space, nor one from a letter to an
#: ASCII character that is none. Both are cuts here, whichever characters stand around them.
PIECE = re.compile(rf"[{_SPACE}]*+[{_LATIN}]++(?=[\x00-@\[-`{{-\x7f]|\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def split_pieces(body: bytes) -> list[str]:
    return PIECE.findall(body.decode())


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def byte_pieces(path: str) -> list[bytes]:
    """The bytes each id stands for, by id: a byte-level vocabulary writes every byte as a printable character."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    model = json.load(open(path))
    pieces = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in model["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text by the tokenizer file ``path`` (byte-level BPE), and the text they decode to.

    Texts are split into words; each distinct word of a block of chunks (``words.block_of``, thousands of chunks of 20 MB) is
    encoded once, so that a word of all texts isn't one task's; ids come back to the documents by position. A chunk's distinct ids are rows, of which the first carry the ids of its documents in parts; a join of them
    with the vocabulary (id, piece) gives what they decode to. Null texts count as
    empty and have no ids; ids of rows may be null or repeated, since rows keep their places.
    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of the decoded text), one row for each input row; with ``with_ids`` also ids array<int>
    and decoded. Other columns are not carried; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    by_word = dictionaries(source, split_pieces, chunk_bytes=CHUNK_BYTES).select("chunk", "idx", "word").repartition("word", block_of(F.col("chunk"))).sortWithinPartitions("word")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_word, last_ids = None, None
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pack_found(t.column("chunk").to_numpy(), t.column("idx").to_numpy(), t.column("ids").combine_chunks())

        for batch in batches:
            distinct = batch.column("word").dictionary_encode()
            words = distinct.dictionary.to_pylist()
            new = words[1:] if words and words[0] == last_word else words
            ids = encode_words([w.decode() for w in new], path)
            if len(new) < len(words):
                ids.insert(0, last_ids)
            if words:
                last_word, last_ids = words[-1], ids[-1]
            held.append(pa.record_batch([batch.column("chunk"), batch.column("idx"), pa.array(ids, pa.binary()).take(distinct.indices)], names=["chunk", "idx", "ids"]))
            rows += batch.num_rows
            if rows >= 100_000:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    found = by_word.mapInArrow(encode, "chunk long, packed binary")

    def place(meta: dict, where: np.ndarray, ids: pa.Array) -> pa.Table:
        n_ids, parts, held, size, at = [], [], [], 0, 0
        own = np.zeros(0, np.uint32)

        def cut() -> None:
            nonlocal held, size, own
            every = np.frombuffer(b"".join(held), "<u4")
            held, size = [], 0
            for i in range(0, len(every), PART_IDS):
                part = every[i : i + PART_IDS]
                own = np.union1d(own, part)
                parts.append(len(part).to_bytes(4, "little") + pack(part))

        for n in meta["n_words"]:
            n_ids.append(0)
            for i in range(at, at + n, PART_IDS):
                flat = joined(ids.take(pa.array(where[i : min(i + PART_IDS, at + n)])))
                n_ids[-1] += len(flat) // 4
                held.append(flat)
                size += len(flat)
                if size >= 4 * PART_IDS:
                    cut()
            at += n
        cut()
        rows = max(1, len(own), len(parts))
        padded = lambda v, kind: pa.concat_arrays([pa.array(v, kind), pa.nulls(rows - len(v), kind)])
        head = json.dumps({"doc_id": meta["doc_id"], "n_ids": n_ids, "rows": rows})
        return pa.table([padded(own, pa.int32()), padded([head], pa.string()), padded(parts, pa.binary())], names=["id", "meta", "part"])

    placed = rejoin(positions(source, split_pieces, chunk_bytes=CHUNK_BYTES), found, place, "id int, meta string, part binary")
    known = byte_pieces(path)
    vocabulary = docs.sparkSession.createDataFrame(pa.table({"piece_id": pa.array(range(len(known)), pa.int32()), "piece": pa.array(known, pa.binary())}))
    # as large as the tokenizer's file, whatever the input; the join keeps the order of the other side's rows
    with_pieces = placed.join(F.broadcast(vocabulary), F.col("id") == F.col("piece_id"), "left").select("id", "meta", "part", "piece")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    types = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, rows = None, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if head is None:
                    if not batch.column("meta")[at].is_valid:
                        raise RuntimeError("a chunk's ids came in another order than they were given")
                    head = json.loads(batch.column("meta")[at].as_py())
                part = batch.slice(at, head["rows"] - rows)
                if part.column("meta").null_count != part.num_rows - (rows == 0):
                    raise RuntimeError("a chunk's ids came mixed with those of another")
                held.append(part.select(["id", "part", "piece"]))
                rows += part.num_rows
                at += part.num_rows
                if rows == head["rows"]:
                    yield from decoded(head, pa.Table.from_batches(held), types)
                    head, held, rows = None, [], 0
        if head is not None:
            raise RuntimeError("a chunk lacks some of its ids")

    return with_pieces.mapInArrow(decode, schema)


def by_document(parts: Iterator[bytes], n_ids: list[int]) -> Iterator[Iterator[np.ndarray]]:
    """The ids of each document in slices, out of packed parts that hold those of all, one after another. Take a document's before the next."""
    rest = np.zeros(0, "<u4")

    def slices_of(n: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while n:
            if not len(rest):
                part = next(parts)
                rest = unpack(part[4:], int.from_bytes(part[:4], "little"))
            own, rest = rest[:n], rest[n:]
            n -= len(own)
            yield own

    for n in n_ids:
        yield slices_of(n)


def decoded(head: dict, rows: pa.Table, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's documents out of (id, piece), each id once, and the parts of their ids beside them."""
    own = rows.column("id").drop_null().to_numpy()
    row_of = np.zeros(int(own.max(initial=0)) + 1, np.int32)
    row_of[own] = np.arange(len(own), dtype=np.int32)
    pieces = rows.column("piece").fill_null(b"").combine_chunks()
    parts = (p.as_py() for p in rows.column("part").drop_null())
    out = {name: [] for name in types.names}

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, types.field(k).type) for k, v in out.items()], schema=types)

    whole = "decoded" in out
    for doc_id, n, slices in zip(head["doc_id"], head["n_ids"], by_document(parts, head["n_ids"])):
        of_ids, of_text, decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        all_ids, texts = [], []
        for ids in slices:
            text = decoder.decode(joined(pieces.take(pa.array(row_of[ids]))))
            of_ids.update(np.ascontiguousarray(ids))
            of_text.update(text.encode())
            if whole:
                all_ids.append(ids.astype(np.int32))
                texts.append(text)
        end = decoder.decode(b"", True)
        of_text.update(end.encode())
        row = {"doc_id": doc_id, "n_tokens": n, "ids_sha256": of_ids.hexdigest(), "decoded_sha256": of_text.hexdigest()}
        if whole:
            row |= {"ids": np.concatenate(all_ids or [np.zeros(0, np.int32)]), "decoded": "".join(texts) + end}
        for k in out:
            out[k].append(row[k])
        if len(out["doc_id"]) == 1000:
            yield batch()
            out = {name: [] for name in types.names}
    yield batch()
