"""Vocabularies of given tokenizers: fertility at every size by one replay of the merges, and added tokens. Nothing is trained here."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import word_counts

#: Symbols before any merge: single bytes.
BYTES = 256

Merge = tuple[bytes, bytes]


def _alphabet() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the others for letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merges_of(spark: SparkSession, path: str) -> list[Merge]:
    """The merges of a byte-level tokenizer file (JSON with model.merges), by rank."""
    model = json.loads(spark.read.text(path, wholetext=True).first()["value"])["model"]
    letters = _alphabet()
    pair = lambda m: m.split(" ") if isinstance(m, str) else m
    return [tuple(bytes(letters[c] for c in side) for side in pair(m)) for m in model["merges"]]


def ranked(merges: Sequence[Merge]) -> dict[Merge, int]:
    """Rank of each pair; ValueError where a merge needs a symbol that only a later one makes, since then prefixes of the list don't nest."""
    made, ranks = {bytes([b]) for b in range(BYTES)}, {}
    for rank, (a, b) in enumerate(merges):
        if a not in made or b not in made:
            raise ValueError(f"merge {rank} joins a symbol that no merge before it makes")
        made.add(a + b)
        ranks.setdefault((a, b), rank)
    return ranks


def applied(word: bytes, ranks: dict[Merge, int]) -> list[int]:
    """Ranks of the merges that encoding ``word`` applies, in order, which is ascending.

    The least rank goes first, at equal ranks the leftmost pair. A merge's symbols come of merges of smaller rank, so under the first r merges
    alone the word goes through the same steps, up to those of rank r: its length then is its bytes less the steps of smaller rank.
    """
    symbols: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p], i) for i in range(len(word) - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    steps = []
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= len(word) or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        steps.append(rank)
        symbols[i], symbols[j] = symbols[i] + symbols[j], None
        after[i] = after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(word) and (p := (symbols[a], symbols[after[a]])) in ranks:
                heapq.heappush(heap, (ranks[p], a))
    return steps


#: Names of sums beside those of ranks: bytes of all words, and words.
_BYTES, _WORDS = -1, -2


def replay(texts: DataFrame, merges: Sequence[Merge], *, prefix: bytes = b"") -> DataFrame:
    """(rank, n): how often encoding all words of texts(text) applies each merge; ranks -1 and -2 have the bytes and the words.

    Each distinct word is encoded once, with ``prefix`` before it, and counts as often as it occurs. The merges, of the tokenizer's own size, go to each worker.
    """
    held = texts.sparkSession.sparkContext.broadcast(ranked(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                body = prefix + word.encode()
                sums[_WORDS] += n
                sums[_BYTES] += n * len(body)
                for rank in applied(body, held.value):
                    sums[rank] += n
            yield pa.record_batch([pa.array(sums.keys(), pa.int32()), pa.array(sums.values(), pa.int64())], names=["rank", "n"])

    return word_counts(texts).mapInArrow(run, "rank int, n long").groupBy("rank").agg(F.sum("n").alias("n"))


def sweep(texts: DataFrame, merges: Sequence[Merge], sizes: Sequence[int], *, base: int = BYTES, prefix: bytes = b"") -> DataFrame:
    """(size, tokens, words, fertility) at each vocabulary size: ``base`` symbols and the first size - base merges. All sizes come of one replay.

    Fertility, tokens for each word, is null without words; null and blank texts have none. ValueError for a size below ``base``.
    """
    if any(s < base for s in sizes):
        raise ValueError(f"a vocabulary has at least its {base} symbols")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    points = [F.struct(F.lit(s).cast("long").alias("size"), (n(F.col("rank") == _BYTES) - n((F.col("rank") >= 0) & (F.col("rank") < s - base))).alias("tokens")) for s in sizes]
    one = replay(texts, merges, prefix=prefix).agg(n(F.col("rank") == _WORDS).alias("words"), F.array(*points).alias("p"))
    return one.select("words", F.inline("p")).select("size", "tokens", "words", (F.col("tokens") / F.nullif(F.col("words"), F.lit(0))).alias("fertility"))


def render_sweep(parts: dict[str, DataFrame]) -> str:
    """A Markdown table of the fertility of each named part at each size; the rows are as many as sizes."""
    found = {name: {r["size"]: r["fertility"] for r in rows.collect()} for name, rows in parts.items()}
    sizes = sorted({s for f in found.values() for s in f})
    cell = lambda v: "-" if v is None else f"{v:.4f}"
    lines = ["| vocabulary | " + " | ".join(found) + " |", "|" + "---|" * (len(found) + 1)]
    return "\n".join(lines + [f"| {s} | " + " | ".join(cell(f.get(s)) for f in found.values()) + " |" for s in sizes]) + "\n"


def with_token(pieces: DataFrame, piece: str) -> DataFrame:
    """pieces(id, piece) with ``piece`` under the next id, if it isn't there; all other ids stay. A vocabulary is of a tokenizer's size."""
    is_it: Column = F.col("piece") == piece
    held = pieces.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("most"), F.coalesce(F.bool_or(is_it), F.lit(False)).alias("there"))
    return pieces.unionByName(held.filter("NOT there").select((F.col("most") + 1).cast(dict(pieces.dtypes)["id"]).alias("id"), F.lit(piece).alias("piece")))
