"""Ranked lexical search: shards of documents searched by pivots and bounds (WAND), and their best merged."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Postings of a shard and questions of a block, about; shards whose results meet at a time.
POSTINGS, BLOCK, FAN = 2_000_000, 2048, 256

#: Bytes of text split at a time, and postings of a batch of the forward index.
SLICE, BATCH = 1 << 20, 250_000

_IS_TERM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Bytes of terms as they are, A-Z in lower case; all others are spaces.
_TERMS = bytes(c if c in _IS_TERM else 32 for c in range(256)).lower()


def term_counts(text: bytes) -> Counter:
    """How often each term occurs: maximal runs of letters, digits and all beyond ASCII in UTF-8, with A-Z alone in lower case."""
    found, rest = Counter(), b""
    for at in range(0, len(text), SLICE):
        part = rest + text[at : at + SLICE].translate(_TERMS)
        cut = part.rfind(b" ") + 1
        found.update(part[:cut].split(b" "))
        rest = part[cut:]
    found.update(rest.split(b" "))
    found.pop(b"", None)
    return found


_FORWARD = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])


def forward_index(texts: DataFrame) -> DataFrame:
    """(id, n, terms, tfs) of texts(id, body): distinct terms of each text that has any, how often each occurs, and all of them with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, body in zip(batch.column("id").to_pylist(), batch.column("body")):
                counts = term_counts(body.as_py())
                if counts:
                    rows.append((key, sum(counts.values()), counts))
                    held += len(counts)
                if held >= BATCH:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(np.cumsum([0] + [len(c) for _, _, c in rows]), pa.int32())
        terms = pa.array([t for _, _, c in rows for t in c], pa.binary()).cast(pa.string())
        tfs = pa.array([f for _, _, c in rows for f in c.values()], pa.int64())
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, tfs)], schema=_FORWARD)

    return texts.mapInArrow(run, "id long, n long, terms array<string>, tfs array<long>")


def wand(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` documents with the largest sum of weight * value over ``lists`` of (documents ascending, values, weight): (sum, document), best first.

    Sums are above 0; of equal ones the smaller document comes first. Lists stand at their next documents, in order of these. The pivot is the
    first document at which the largest impacts of the lists up to it exceed the least sum held: no document before it can get among the
    best, so the lists before it skip to it; where they all stand at it, it is scored.
    """
    most = [w * max(values) for _, values, w in lists]
    bits = max(1, len(lists).bit_length())
    low = (1 << bits) - 1
    heads = sorted(docs[0] << bits | i for i, (docs, _, _) in enumerate(lists))  # next document, and the list
    at = [0] * len(lists)
    best: list[tuple[int, int]] = []  # a heap of (sum, -document)
    least = 0
    while heads:
        bound, p = 0, -1
        for j, h in enumerate(heads):
            bound += most[h & low]
            if bound > least:
                p = j
                break
        if p < 0:
            break
        pivot = heads[p] >> bits
        if heads[0] >> bits == pivot:
            total, moved = 0, 0
            for h in heads:
                if h >> bits != pivot:
                    break
                docs, values, w = lists[h & low]
                total += w * values[at[h & low]]
                moved += 1
            if total > least:
                if len(best) < k:
                    heapq.heappush(best, (total, -pivot))
                else:
                    heapq.heapreplace(best, (total, -pivot))
                if len(best) == k:
                    least = best[0][0]
            goal = pivot + 1
        else:
            moved, goal = p, pivot
        fresh = []
        for h in heads[:moved]:
            i = h & low
            docs = lists[i][0]
            a = at[i] + 1 if h >> bits >= goal - 1 and h >> bits < goal else at[i]
            if a < len(docs) and docs[a] < goal:
                a = bisect_left(docs, goal, a)
            at[i] = a
            if a < len(docs):
                fresh.append(docs[a] << bits | i)
        heads[:moved] = fresh
        heads.sort()
    return [(s, -d) for s, d in sorted(best, key=lambda x: (-x[0], -x[1]))]


_FOUND = pa.schema([("item_id", pa.int64()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def search_shard(x: pa.Table, q: pa.Table, k: int) -> pa.Table:
    """Best ``k`` of each question of q(item_id, terms, weights) among the documents of x(shard, id, m, terms, tfs)."""
    if not x.num_rows or not q.num_rows:
        return _FOUND.empty_table()
    x = x.take(pc.sort_indices(x, [("id", "ascending")])).combine_chunks()
    ids, m = x.column("id").to_numpy(), x.column("m").to_numpy()
    terms, tfs = (x.column(c).chunk(0).flatten() for c in ("terms", "tfs"))
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(x.column("terms").chunk(0)).to_numpy())
    asked = pc.unique(q.column("terms").combine_chunks().flatten())
    code = pc.index_in(terms, value_set=asked).fill_null(-1).to_numpy()
    held = np.flatnonzero(code >= 0)
    code, doc, tf = code[held], doc[held], tfs.to_numpy()[held]
    value = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    order = np.argsort(code, kind="stable")  # documents stay ascending
    starts = np.searchsorted(code[order], np.arange(len(asked) + 1))
    place = {t: i for i, t in enumerate(asked.to_pylist())}
    lists: dict[int, tuple[list[int], list[int]]] = {}

    def posted(i: int) -> tuple[list[int], list[int]]:
        if i not in lists:
            part = order[starts[i] : starts[i + 1]]
            lists[i] = doc[part].tolist(), value[part].tolist()
        return lists[i]

    out: list[tuple] = []
    for item, words, weights in zip(q.column("item_id").to_pylist(), q.column("terms").to_pylist(), q.column("weights").to_pylist()):
        mine = [(*posted(place[t]), w) for t, w in zip(words, weights) if starts[place[t]] < starts[place[t] + 1]]
        best = wand(mine, k)
        if best:
            out.append((item, [int(ids[d]) for _, d in best], [s for s, _ in best]))
    shard = x.column("shard")[0].as_py()
    return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([shard] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))], schema=_FOUND)


def _best_of(lists: pa.Table, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the best ``k`` of lists that are in order each."""
    ways = [zip([-s for s in scores], ids) for ids, scores in zip(lists.column("ids").to_pylist(), lists.column("scores").to_pylist())]
    return list(islice(heapq.merge(*ways), k))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """The ``k`` documents that score highest for each item, by whole numbers in place of BM25's fractions.

    A term weighs floor(1000 * ln((2N + 2) / (2df + 1))), and adds, for each time the item has it, weight * (10^9 tf div (1000 tf + 12 m)), where
    m is 75 + (25 n N) div L: N documents with terms, L terms in all, n in the document, df documents with the term, tf times in this one. The
    counts are over all documents.

    Documents are dealt by a hash of their ids to shards of about ``postings`` terms, items to blocks; a shard meets a block in one task, which
    holds the shard's postings of the block's terms and goes through them by ``wand``. The shards' results, k rows each, meet FAN shards at a time. The
    result is exact. Nothing is broadcast.

    Returns item_id, rank (from 1), doc_id, score (above 0), highest first, equal scores by the smaller id; fewer than ``k`` where fewer score.
    Items with null text or without terms that any document has, and empty tables, give no rows; documents with null or empty text no hits. Rows that repeat an
    item's id are one item with the terms of all; rows that repeat a document's id are documents of their own. Documents with a null id count
    but are not returned; items with a null id are left out. Other columns are not carried.
    """
    body = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary").alias("body")
    forward = stash(forward_index(docs.select(F.col(id_col).cast("long").alias("id"), body(text_col))), "forward")
    n_docs, n_terms, n_posted = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    asked = forward_index(items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), body(item_text_col))).select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    asked = asked.groupBy(F.col("id").alias("item_id"), F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("times"))
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    wanted = stash(weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("w")).select("item_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights")), "asked")
    shards, blocks = max(1, -(-n_posted // postings)), max(1, -(-wanted.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {max(1, n_terms)}L")
    left = forward.filter("id IS NOT NULL").select(deal("id", shards).alias("shard"), every(blocks).alias("block"), "id", m.alias("m"), "terms", "tfs")
    right = wanted.select(every(shards).alias("shard"), deal("item_id", blocks).alias("block"), "item_id", "terms", "weights")
    lists = "item_id long, shard int, ids array<long>, scores array<long>"
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda x, q: search_shard(x, q, k), lists)

    def some(key: tuple, part: pa.Table) -> pa.Table:
        best = _best_of(part, k)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([[i for _, i in best]], pa.list_(pa.int64())), pa.array([[-s for s, _ in best]], pa.list_(pa.int64()))], schema=_FOUND)

    def last(key: tuple, part: pa.Table) -> pa.Table:
        best = _best_of(part, k)
        return pa.table({"item_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()), "doc_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.int64())})

    while shards > FAN:
        found = found.withColumn("shard", F.expr(f"shard div {FAN}").cast("int")).groupBy("item_id", "shard").applyInArrow(some, lists)
        shards = -(-shards // FAN)
    return found.groupBy("item_id").applyInArrow(last, "item_id long, rank int, doc_id long, score long")
