"""Best-two-fit packing of documents into token sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import number_within, stash
from .words import slices

#: Words whose ids a worker keeps, some 200 bytes each; beyond them it starts anew.
KEPT_WORDS = 300_000

_MARKS = tuple(bytes([c]) for c in b".,;:!?)|")


# The steps before the model, and the pattern of words, by which a run of letters is one word.
_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words that those steps leave as they are, but for writing their bytes as characters: these go to the model at once.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_AS_BYTES = {c: "".join(chr(b) if 160 < b != 173 else chr(256 + b - 94 if b < 161 else 323) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordIds:
    """Ids of words as bytes, for tokenizers that lower-case and to which white space is nothing but a boundary."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        file = json.load(open(path))
        self.special = [t["content"].encode() for t in file["added_tokens"]]
        steps = [x["type"] for x in file["normalizer"]["normalizers"]] + [x["type"] for x in file["pre_tokenizer"]["pretokenizers"]]
        plain = steps == _STEPS and file["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _PATTERN}
        self.model = _tokenizer(path).model if plain else None

    def texts(self, bodies: list[bytes]) -> Iterator[bytes]:
        split = [self._lower(b).split() for b in bodies]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        new = set().union(*split).difference(known)
        # Between a letter and a mark after it lies a boundary of tokens too.
        marked = [w for w in new if w[-1:] in _MARKS and w[-2:-1].isalpha() and not w.endswith(tuple(self.special))]
        new.difference_update(marked)
        new.update({x for w in marked for x in (w[:-1], w[-1:])}.difference(known))
        words = []
        for w in new:
            s = w.decode()
            if self.model and _LETTERS.fullmatch(s):
                known[w] = array("I", [t.id for t in self.model.tokenize(s if s.isascii() else s.translate(_AS_BYTES))]).tobytes()
            else:
                words.append(w)
        for w, e in zip(words, _tokenizer(self.path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]
        for words in split:
            yield b"".join(map(known.__getitem__, words))

    def _lower(self, body: bytes) -> bytes:
        """A-Z in lower case, unless that would make a special token of other text."""
        low = body.lower()
        return body if any(t in low for t in self.special) else low


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, length: int, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: (doc_id, piece, start, length, ids_crc32[, ids]).

    A text's ids, then ``end_id``, are cut only where they are more than ``length``. The tokenizer must drop white
    space between words, so that a text's ids are those of its words.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path)
        for batch in slices(batches, "body", 4_000_000):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.texts(batch.column("body").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32))):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts[length]`` documents of each length: [(how many such bins, [(length, documents)])].

    A bin is filled greedily, by the largest document that fits; then, as long as that closes its gap further, its
    smallest document makes way for the two unpacked ones that fit best into the gap that leaves. Since
    documents of a length are alike, a bin is repeated as often as the counts allow: the work depends on the number of
    lengths, at most ``capacity``, and not on that of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan = []
    while left.any():
        have, used, gap = left.copy(), {}, capacity
        while gap and len(fit := np.flatnonzero(have[1 : gap + 1])):
            n = int(fit[-1]) + 1
            k = int(min(have[n], gap // n))
            used[n] = used.get(n, 0) + k
            have[n] -= k
            gap -= n * k
        while gap and used and have.any():
            small = min(used)
            pair = _best_pair(have, gap + small)
            if pair is None or sum(pair) <= small:
                break
            used[small] -= 1
            have[small] += 1
            if not used[small]:
                del used[small]
            for n in pair:
                used[n] = used.get(n, 0) + 1
                have[n] -= 1
            gap -= sum(pair) - small
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def _best_pair(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths at hand with the largest sum within ``room``."""
    top = min(room, len(have) - 1)
    at_most = np.maximum.accumulate(np.where(have[: top + 1] > 0, np.arange(top + 1), 0))
    a = np.flatnonzero(have[: top + 1])
    a = a[a < room]
    if not len(a):
        return None
    b = at_most[np.minimum(room - a, a)]
    b = np.where((b == a) & (have[a] < 2), at_most[np.minimum(room - a, a - 1)], b)
    total = np.where(b > 0, a + b, 0)
    i = int(np.argmax(total))
    return (int(a[i]), int(b[i])) if total[i] else None


def lay_out(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Where the documents of a length go, by their number among these: rows of length, first number, documents in a bin, first bin, first offset."""
    rows, bins, seen = [], 0, {}
    for times, content in plan:
        offset = 0
        for n, k in content:
            rows.append((n, seen.get(n, 0), k, bins, offset))
            seen[n] = seen.get(n, 0) + times * k
            offset += n * k
        bins += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts``, a stored table with doc_id, piece, start, length, ids_crc32, with sequence_id and offset.

    The counts of the lengths, ``capacity`` numbers at most, make the plan on the driver; each piece finds its
    place by its length and its number among those of that length.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = lay_out(best_two_fit(counts, capacity))
    sent = parts.sparkSession.sparkContext.broadcast(table)
    numbered = number_within(parts, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_number", sum(counts.values()))

    names = list(parts.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = t[:, 0] * (1 << 48) + t[:, 1]
        for batch in batches:
            n, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            row = t[np.searchsorted(keys, n * (1 << 48) + number, "right") - 1] if len(t) else np.zeros((0, 5), np.int64)
            k = number - row[:, 1]
            columns = [batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * n)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, *, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``length`` tokens.

    A document's tokens are its ids by the tokenizer file ``path``, then ``end_id``; null texts count as empty and
    have that one token. Only a document of more than ``length`` tokens is cut; its last piece may be shorter.
    Returns doc_id, piece, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit
    integers), sequence_id, offset (gapless from 0 in the sequence), and with ``with_ids`` ids array<int>. Null and repeated ids are
    carried; other columns are not; an empty table gives an empty result.
    """
    return pack(stash(pieces(docs, path, length, end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces"), length)
