"""Scores of a prediction-by-partial-matching model over bytes, and of a word count model beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .words import block_of, dictionaries, positions, rejoin, slices

#: Bytes of which contexts of three may consist: all.
ALPHABET = 256

#: Contexts of three of the most frequent bytes are scored by a broadcast trie, which has at most HOT**3 + 256**2 + 256 + 1
#: contexts (under 130,000) of at most 256 symbols, however large the corpus. All others are scored by a join.
HOT = 40

#: Stands before a code in the dictionaries; no word has it.
_CODE = b" "

#: Rows of counts in a part of the contexts that are scored by a join.
_PART_ROWS = 200_000

#: Stands before and after each text; no UTF-8 text has it.
EDGE = 0xFF

#: Bytes of text in a chunk, and of those that are scored at a time.
_CHUNK_BYTES, _SLICE_BYTES = 12_000_000, 1_000_000


def _lower_words(body: bytes) -> list[bytes]:
    return body.lower().split()


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the texts, and the edge after each, with its three bytes of context: codes of 32 bits; where they start and how many they are, by text."""
    pad = bytes([EDGE]) * 3
    x = np.frombuffer(b"".join([part for b in bodies for part in (pad, b.lower(), pad[:1])]), np.uint8)
    n = np.array([len(b) + 1 for b in bodies], np.int64)
    if not len(n):
        return np.zeros(0, np.uint32), n, n
    y = x.astype(np.uint32)
    codes = y[:-3] << 24 | y[1:-2] << 16 | y[2:-1] << 8 | y[3:]
    begins = np.cumsum(n + 3) - (n + 3)
    keep = np.ones(len(codes), bool)
    for k in range(1, 4):  # the padding of the next text is no symbol of this one
        keep[begins[1:] - k] = False
    starts = np.cumsum(n) - n
    return codes[keep], starts, n


def count_contexts(source: DataFrame) -> DataFrame:
    """(code long, n long): how often each byte came after each three, over the whole texts of source(body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in slices(batches, "body", 4 * _SLICE_BYTES):
            c, n = np.unique(_windows([b or b"" for b in batch.column("body").to_pylist()])[0], return_counts=True)
            codes, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.record_batch([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    return source.select("body").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Trie:
    """Log10 probabilities of all symbols in every context of frequent bytes, and the counts of orders 0 to 2 for those of others."""

    def __init__(self, counts: DataFrame):
        """``counts``: a stored table of count_contexts. Only what the bounded trie holds comes to the driver."""
        symbol, context = F.col("code").bitwiseAND(255), F.shiftright("code", 8)
        frequent = [r["s"] for r in counts.groupBy(symbol.alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(HOT).collect()]
        if EDGE not in frequent:
            frequent = [EDGE, *frequent[: HOT - 1]]
        self.rank = np.full(256, HOT, np.int64)
        self.rank[frequent] = np.arange(len(frequent))
        inside = F.lit(True)
        for shift in (8, 16, 24):
            inside = inside & F.shiftright("code", shift).bitwiseAND(255).isin(frequent)
        third = self._rows(counts.filter(inside).select(context.alias("c"), symbol.alias("s"), "n"))
        second = self._rows(counts.groupBy(context.bitwiseAND(0xFFFF).alias("c"), symbol.alias("s")).agg(F.sum("n").alias("n")))
        levels = [third, second]
        first = np.zeros((256, 256), np.int64)
        np.add.at(first, second[0] & 255, second[1])
        levels += [(np.arange(256), first), (np.zeros(1, np.int64), first.sum(0, keepdims=True))]
        self.shorter = levels[1:]
        self.table, places = self._probabilities(levels)
        self.by_two = np.repeat(np.where(first.any(1), places[2], places[3][0])[None, :], 256, 0).ravel()
        self.by_two[second[0]] = places[1]
        self.by_three = np.full((HOT + 1) ** 3, -1, np.int64)
        self.by_three[self._three(third[0])] = places[0]

    @staticmethod
    def _rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and their counts by symbol."""
        t = df.toArrow()
        c, s, n = (t.column(i).to_numpy().astype(np.int64) for i in range(3))
        contexts, row = np.unique(c, return_inverse=True)
        counts = np.zeros((len(contexts), 256), np.int32 if n.max(initial=0) < 2**31 else np.int64)
        counts[row, s] = n
        return contexts, counts

    def _three(self, contexts: np.ndarray) -> np.ndarray:
        r = self.rank
        return (r[contexts >> 16 & 255] * (HOT + 1) + r[contexts >> 8 & 255]) * (HOT + 1) + r[contexts & 255]

    @staticmethod
    def _probabilities(levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Method C: of a context with n counts of d symbols, an escape has d of n + d; the symbols it leaves out go
        by the next shorter context, without those that a longer one has; at last all that are left are equally likely."""
        total = sum(len(c) for c, _ in levels)
        table, places, at = np.zeros((total, 256), np.float32), [], 0
        for depth, (contexts, _) in enumerate(levels):
            places.append(np.arange(at, at + len(contexts)))
            for begin in range(0, len(contexts), 4096):
                part = contexts[begin : begin + 4096]
                table[at + begin : at + begin + len(part)] = Trie._logs(levels, depth, part)
            at += len(contexts)
        return table, places

    @staticmethod
    def _logs(levels: list[tuple[np.ndarray, np.ndarray]], depth: int, part: np.ndarray) -> np.ndarray:
        """Of all symbols in the contexts ``part`` of level ``depth``. Contexts that a level lacks have no counts there."""
        escape, free, p = np.ones((len(part), 1)), np.ones((len(part), 256), bool), np.zeros((len(part), 256))
        for k in range(depth, 4):
            known, counts = levels[k]
            if not len(known):
                continue
            key = part if k == depth else part & (0xFFFF if k == 1 else 0xFF if k == 2 else 0)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            c = counts[at] * free * (known[at] == key)[:, None]
            n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            some = n > 0
            p += np.where(some, escape * c / np.maximum(n + d, 1), 0)
            escape = np.where(some, escape * d / np.maximum(n + d, 1), escape)
            free &= c == 0
        p += free * escape / np.maximum(free.sum(1, keepdims=True), 1)
        return np.log10(p)

    def logs(self, codes: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of ``codes``, where ``known`` codes of the same contexts of three have the counts ``n``."""
        out, order = np.zeros(len(codes)), np.argsort(codes, kind="stable")
        by_code = np.argsort(known)
        known, n = known[by_code], n[by_code]
        contexts, starts = np.unique(codes[order] >> 8, return_index=True)
        starts = np.r_[starts, len(codes)]
        for begin in range(0, len(contexts), 4096):
            part = contexts[begin : begin + 4096]
            i, j = np.searchsorted(known, [part[0] << 8, part[-1] + 1 << 8])
            row = np.searchsorted(part, known[i:j] >> 8)
            own = part[np.minimum(row, len(part) - 1)] == known[i:j] >> 8
            counts = np.zeros((len(part), 256), np.int64)
            counts[row[own], known[i:j][own] & 255] = n[i:j][own]
            table = self._logs([(part, counts), *self.shorter], 0, part)
            places = order[starts[begin] : starts[begin + len(part)]]
            out[places] = table[np.searchsorted(part, codes[places] >> 8), codes[places] & 255]
        return out

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """Log10 probability of each text, its end included, without the symbols that have a rare byte in their context."""
        codes, starts, _ = _windows(bodies)
        if not len(codes):
            return np.zeros(len(bodies))
        codes = codes.astype(np.int64)
        row = self.by_three[self._three(codes >> 8)]
        row = np.where(row < 0, self.by_two[codes >> 8 & 0xFFFF], row)
        logs = self.table.ravel()[row * 256 + (codes & 255)].astype(np.float64)
        logs[_rare(codes, self.rank < HOT)] = 0
        return np.add.reduceat(logs, starts)


def _rare(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether a byte of the context is not among the ``hot`` ones."""
    return ~(hot[codes >> 24 & 255] & hot[codes >> 16 & 255] & hot[codes >> 8 & 255])


def code_logs(entries: DataFrame, counted: DataFrame, trie, hot: np.ndarray) -> DataFrame:
    """(word, block, value): the log10 probability of each distinct code of entries(word, block), from all counts of its context of three."""
    frequent = np.flatnonzero(hot).tolist()
    inside = F.lit(True)
    for shift in (8, 16, 24):
        inside = inside & F.shiftright("code", shift).bitwiseAND(255).isin(frequent)
    rest = counted.filter(~inside)
    parts = max(64, -(-rest.count() // _PART_ROWS))
    part = F.pmod(F.xxhash64(F.shiftright("code", 8)), F.lit(parts)).alias("part")
    asked = entries.select("word", "block").distinct().withColumn("code", F.conv(F.hex(F.expr("substring(word, 2)")), 16, 10).cast("long"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, known, n = (t.column(c).to_numpy().astype(np.int64) for t, c in ((left, "code"), (right, "code"), (right, "n")))
        return pa.table({"word": left.column("word"), "block": left.column("block"), "value": pa.array(trie.value.logs(codes, known, n), pa.float64())})

    return asked.select(part, "word", "block", "code").groupBy("part").cogroup(rest.select(part, "code", "n").groupBy("part")).applyInArrow(run, "word binary, block long, value double")


def ppm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Score all documents by models learned from those whose crc32(id as text) mod ``folds`` is not 0.

    Texts have A-Z lower-cased. Base: tokens are words without ASCII white space and one end for each text;
    base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))). Score: the log10 probability that a byte-context trie of
    order 3, escape method C with symbol exclusion, pretrained on the learning texts, gives the text's UTF-8
    bytes and its end. Counts of both come from all learning texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each input row. Null texts
    count as empty (one token, the end); a null id is that of the empty text and so held out. Where nothing is
    learned, N and V are 0 and the bytes equally likely. Other columns are not carried; an empty table gives an
    empty result.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), (F.crc32(id_text) % folds != 0).alias("train"))
    spark = docs.sparkSession
    counted = stash(count_contexts(source.filter("train")), "contexts")
    built = Trie(counted)
    hot, trie = built.rank < HOT, spark.sparkContext.broadcast(built)

    def split(body: bytes) -> list[bytes]:
        """Words, then the codes that the broadcast trie doesn't score."""
        codes = _windows([body])[0]
        raw = codes[_rare(codes, hot)].astype(">u4").tobytes()
        return _lower_words(body) + [_CODE + raw[i : i + 4] for i in range(0, len(raw), 4)]

    is_code = F.expr("substring(word, 1, 1)") == F.lit(bytearray(_CODE))
    entries = stash(dictionaries(source, split, chunk_bytes=_CHUNK_BYTES).select("chunk", "idx", "word", "n_train"), "entries")
    entries = entries.withColumn("block", block_of(F.col("chunk")))
    worded, coded = entries.filter(~is_code), entries.filter(is_code)
    # A word of every chunk has a row for each: they are summed by block, then a row for each block meets in the word's window.
    by_word = Window.partitionBy("word")
    sums = worded.groupBy("word", "block").agg(F.sum("n_train").alias("c"))
    known = stash(sums.select("word", "block", F.sum("c").over(by_word).alias("c"), (F.min("block").over(by_word) == F.col("block")).alias("first")), "word-counts")
    row = known.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = counted.filter(F.col("code").bitwiseAND(255) == EDGE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = row["n"] + ends, row["v"] + (ends > 0)
    below = float(np.log10(total + 0.1 * (distinct + 1)))

    def extra(batch: pa.RecordBatch) -> dict:
        scores, held = [], []
        for part in slices(iter([batch]), "body", _SLICE_BYTES):
            scores += trie.value.score([b or b"" for b in part.column("body").to_pylist()]).tolist()
            held += [not t for t in part.column("train").to_pylist()]
        return {"score": scores, "held_out": held}

    def assemble(meta: dict, where: np.ndarray, c: pa.Array) -> pa.Table:
        c = c.to_numpy()[where]  # counts of words, and logs of probabilities, below 0, of codes
        size = len(meta["n_words"])
        owner = np.repeat(np.arange(size), np.array(meta["n_words"], np.int64))
        rare = c < 0
        score = np.array(meta["score"], np.float64) + np.bincount(owner[rare], c[rare], size)
        owner, c = owner[~rare], c[~rare]
        n = np.bincount(owner, minlength=size).astype(np.int64)
        logs, seen = np.log10(c + 0.1), c > 0
        base = np.bincount(owner, logs, size) + np.log10(ends + 0.1) - (n + 1) * below
        n_known = np.bincount(owner, seen, size).astype(np.int64) + (ends > 0)
        return pa.table({"doc_id": pa.array(meta["doc_id"], pa.int64()), "held_out": meta["held_out"], "n_tokens": n + 1, "n_known": n_known, "train_tokens": np.full(len(n), total), "base_score": base, "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    values = known.select("word", "block", F.col("c").cast("double").alias("value")).unionByName(code_logs(coded, counted, trie, hot))
    found = entries.join(values, ["word", "block"]).select("chunk", "idx", "value")
    return rejoin(positions(source, split, extra, chunk_bytes=_CHUNK_BYTES), found, assemble, schema)
