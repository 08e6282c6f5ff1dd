"""Near duplicates by MinHash, with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import components
from .words import Numbers, slices

#: Signature of BANDS * ROWS hashes. At a similarity of 0.8 two sets share a band but for 3 in a million cases.
BANDS, ROWS = 32, 5

#: Hashes compared at a time, and the posterior probability of a link below which a pair is given up.
BATCH, MISS = 16, 1e-6

#: Leaders of a bucket, each by an order of its own.
TURNS = 3

#: Classes and bytes of their texts in a part of a bucket: parts are dealt by a hash, so they hold about so much, or one longer text.
PART, PART_BYTES = 2048, 4_000_000

#: Binary logarithm of the bits of the filter of texts, and shingles looked up at a time.
BITMAP, LOOK_UPS = 27, 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(words: list[bytes], width: int) -> tuple[int, bytes, np.ndarray]:
    """Size, SHA-256 and 64-bit hashes of the set of ``width``-word shingles; of the whole sequence as one if it is shorter.

    Shingles are told apart by their words, not by hashes: a distinct word has its rank among the text's sorted words, and a shingle
    the number that its ranks make. Words and numbers are what the SHA-256 covers, so it is that of the set.
    """
    index = Numbers()
    place = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    distinct = sorted(index)
    size, k = len(distinct), min(width, len(words))
    rank = np.empty(size, np.int64)
    rank[[index[w] for w in distinct]] = np.arange(size)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, size)
    ids, n = rank[place], len(words) - k + 1
    digest = hashlib.sha256(b"%d %d\n%s\n" % (k, size, b" ".join(distinct)))
    code, room = ids[:n].copy(), size
    for j in range(1, k):
        if room * size >= 2**62:  # numbers anew, from 0 on
            names, code = np.unique(code, return_inverse=True)
            digest.update(names.tobytes())
            room = len(names)
        code, room = code * size + ids[j : n + j], room * size
    codes, first = np.unique(code, return_index=True)
    digest.update(codes.tobytes())
    h = np.full(len(first), k, np.uint64)
    for j in range(k):
        h = (h ^ hashes[ids[first + j]]) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX2
        h ^= h >> np.uint64(32)
    return len(codes), digest.digest(), h


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of shingle_set."""
    return np.unique(shingle_set(words, width)[2]) if words else np.zeros(0, np.uint64)


@cache
def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20_240_229)
    return rnd.integers(0, 2**32, size, np.uint32)[:, None], (rnd.integers(0, 2**32, size, np.uint32) | np.uint32(1))[:, None]


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least value of the set under each of ``size`` 32-bit hash functions."""
    seeds, factors = _family(size)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        v = (x[None, at : at + 4096] ^ seeds) * factors
        v ^= v >> np.uint32(15)
        np.minimum(low, (v * np.uint32(0x2C1B3C6D)).min(1), out=low)
    return low


def _signatures(source: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, no_id, th, size, n, ck, sig, bands) of source(id, no_id, th, body): bytes, set size, set digest, a byte of each least value, and band keys."""
    kept = ["id", "no_id", "th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 8_000_000):
            sizes, n, ck, sig, keys = [], [], [], [], []
            for body in batch.column("body"):
                body = body.as_py()
                words = body.lower().split()
                sizes.append(len(body))
                if not words:
                    n.append(0), ck.append(None), sig.append(None), keys.append(None)
                    continue
                count, digest, hashes = shingle_set(words, width)
                s = signature(hashes, bands * rows)
                n.append(count), ck.append(digest)
                sig.append(s.astype(np.uint8).tobytes())
                raw = s.reshape(bands, rows)
                keys.append(np.array([xxhash.xxh3_64_intdigest(raw[i].tobytes(), i) for i in range(bands)], np.uint64).view(np.int64))
            yield pa.record_batch(
                [*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(ck, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*kept, "size", "n", "ck", "sig", "bands"],
            )

    return source.mapInArrow(run, "id long, no_id boolean, th binary, size long, n long, ck binary, sig binary, bands array<long>")


@cache
def least_matches(size: int, percent: int, miss: float, batch: int) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) for each batch.

    With a uniform prior of the rate at which bytes agree, of which m of h did, it is Beta(m + 1, h - m + 1); that it
    reaches t has the probability that at most m of h + 1 trials of chance t succeed. t allows for bytes that agree by
    chance.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for h in range(batch, size + 1, batch):
        below, m = 0.0, 0
        while m <= h:
            below += math.comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((h, m))
    return out


def likely(left: np.ndarray, right: np.ndarray, percent: int, miss: float, batch: int) -> np.ndarray:
    """Which rows of two byte matrices stay above the posterior bound, batch after batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for h, least in least_matches(left.shape[1], percent, miss, batch):
        matches[alive] += (left[alive, h - batch : h] == right[alive, h - batch : h]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def numbered(bodies: Iterable[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts as numbers, equal where all words are: those of a text after another, and where each text's begin and end."""
    index, texts = Numbers({b"": 0}), []
    for body in bodies:
        words = body.lower().split()
        w = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        texts.append(np.r_[w, np.zeros(max(0, width - len(w)), np.int64)])  # no word has the number 0
    counts = np.array([len(w) - width + 1 for w in texts], np.int64)
    name = np.concatenate([w[: len(w) - width + 1] for w in texts])
    for j in range(1, width):
        name = np.unique(name, return_inverse=True)[1] if j > 1 else name
        name = name * len(index) + np.concatenate([w[j : len(w) - width + 1 + j] for w in texts])
    names, name = np.unique(name, return_inverse=True)
    sets = np.unique(np.repeat(np.arange(len(texts)), counts) * len(names) + name)
    owner, ids = np.divmod(sets, len(names))
    return ids, np.searchsorted(owner, np.arange(len(texts) + 1))


def _shared(mark: np.ndarray, ids: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of the numbers of each set in ``of`` are marked."""
    size = starts[of + 1] - starts[of]
    ends = np.cumsum(size)
    at = np.repeat(starts[of] - ends + size, size) + np.arange(ends[-1])
    return np.add.reduceat(mark[ids[at]], ends - size, dtype=np.int64)


def _partners(t: pa.Table, key: tuple, percent: int, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of a group that signatures leave possible, across roots.

    Of a leader's group (j below 0), the pairs of the leader, part 0, with its followers. Of two parts i and j of a bucket, a pair
    counts in the first band that it shares, alone; of two different parts, only pairs across them do.
    """
    g, i, j = (k.as_py() for k in key)
    root, n, part = (t.column(c).to_numpy() for c in ("root", "n", "part"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    led, own = j < 0, 0
    if not led:
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        own = int(np.flatnonzero((bands == g).all(0))[0])
    for x in np.flatnonzero(part == 0).tolist() if led else range(len(n)):
        y = np.flatnonzero(part != 0) if led else np.arange(x + 1, len(n))
        if not led and i != j:
            y = y[part[y] != part[x]]
        y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        if own and len(y):
            y = y[~(bands[y, :own] == bands[x, :own]).any(1)]
        if len(y):
            y = y[likely(sig[y], np.broadcast_to(sig[x], (len(y), sig.shape[1])), percent, miss, BATCH)]
        if len(y):
            yield x, y


def _links(rows: DataFrame, slim: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) that join the roots of rows(g, i, j, part, node, root), groups of classes by (g, i, j); stored.

    First the signatures tell which classes of a group have a possible partner; these come again with their texts, and are compared
    on full sets within the group. Pairs are never rows: a group sends the links that join what no earlier one of its own has joined.
    """
    keys = ["g", "i", "j"]

    def possible(key: tuple, t: pa.Table) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for x, y in _partners(t, key, percent, miss):
            some[x] = some[y] = True
        return t.select([*keys, "part", "node", "root"]).filter(pa.array(some))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy())))
        node, label = t.column("node").to_numpy(), t.column("root").to_numpy().copy()
        ids, starts = numbered((b.as_py() for b in t.column("body")), width)
        sizes, mark = np.diff(starts), np.zeros(int(ids.max()) + 1, np.uint8)
        found: list[tuple[int, int]] = []
        for x, ys in _partners(t.drop_columns("body"), key, percent, miss):
            own = ids[starts[x] : starts[x + 1]]
            mark[own] = 1
            ends = np.cumsum(sizes[ys])
            for some in np.split(ys, np.searchsorted(ends, np.arange(LOOK_UPS, ends[-1], LOOK_UPS))):
                some = some[label[some] != label[x]]
                if len(some):
                    both = _shared(mark, ids, starts, some)
                    for y in some[100 * both >= percent * (sizes[x] + sizes[some] - both)].tolist():
                        if label[y] != label[x]:
                            label[label == label[y]] = label[x]
                            found.append((int(node[x]), int(node[y])))
            mark[own] = 0
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    likely_ = stash(rows.join(slim, "node").groupBy(*keys).applyInArrow(possible, "g long, i int, j int, part int, node long, root long"), "possible")
    asked = stash(likely_.select("node").distinct(), "asked")
    texts = texts.join(asked, "node", "left_semi")
    return stash(likely_.join(slim, "node").join(texts, "node").groupBy(*keys).applyInArrow(compare, "a long, b long"), "links")


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts) of the stored rows(key, size): into how many parts of PART classes and PART_BYTES bytes each key's rows go."""
    counts = rows.groupBy(key).agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    return stash(counts.select(key, F.greatest(F.ceil(F.col("c") / PART), F.ceil(F.col("s") / PART_BYTES), F.lit(1)).cast("int").alias("parts")), "parts")


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs(id, no_id, th, body) that may be among the stored wanted(id, no_id, th), each once in a task: a filter that saves a shuffle, no more.

    It is a bitmap of 2**BITMAP bits, whatever the input, by a hash; where very many are wanted it lets more and more pass.
    """
    keys = ["id", "no_id", "th"]
    place = F.xxhash64(*keys).bitwiseAND((1 << BITMAP) - 1)
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))"))
    cells = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 5).cast("int").alias("cell")).agg(bits.alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 5), np.uint32)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = batch.column("place").to_numpy()
            batch = batch.select([*keys, "body"]).filter(pa.array((sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            fresh = []
            for row in zip(*(batch.column(c).to_pylist() for c in keys)):
                fresh.append(row not in seen)
                seen.add(row)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return docs.select(*keys, "body", place.alias("place")).mapInArrow(run, "id long, no_id boolean, th binary, body binary")


def _led(open_: DataFrame) -> DataFrame:
    """Groups of leaders for _links: each class of the stored open_(band, node, root, size) with TURNS leaders of its buckets, a pair once."""
    turns = [F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), "node", "root")).alias(f"l{turn}") for turn in range(TURNS)]
    leaders = stash(open_.groupBy("band").agg(*turns).select("band", F.array_distinct(F.array(*[F.col(f"l{t}").dropFields("p") for t in range(TURNS)])).alias("leaders")), "leaders")
    led = open_.join(leaders, "band").select("node", "root", "size", F.explode("leaders").alias("l")).filter("l.root <> root")
    once = led.groupBy(F.least("l.node", "node").alias("a"), F.greatest("l.node", "node").alias("b")).agg(F.min(F.struct("l", "node", "root", "size")).alias("p"))
    pairs = stash(once.select(F.col("p.l.node").alias("g"), F.col("p.l.root").alias("leads"), "p.node", "p.root", "p.size"), "pairs")
    parts = _parts(pairs, "g")
    tail = [F.lit(-1).alias("j")]
    followers = pairs.join(parts, "g").select("g", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), *tail, F.lit(1).alias("part"), "node", "root")
    heads = pairs.select("g", "leads").distinct().join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), *tail, F.lit(0).alias("part"), F.col("g").alias("node"), F.col("leads").alias("root"))
    return stash(followers.unionByName(heads), "led")


def _across(open_: DataFrame) -> DataFrame:
    """Groups of every two parts of a bucket for _links, of the stored open_(band, node, root, size)."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = open_.join(_parts(open_, "band"), "band").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(F.col("band").alias("g"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "root")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows of labelled(band, node, root, size) of the bands in which there is more than one root; stored."""
    labelled = stash(labelled, "labelled")
    mixed = stash(labelled.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("band"), "mixed")
    return stash(labelled.join(mixed, "band"), "open")


def _moves(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(old, new) roots by links(a, b) and roots(node, root); stored."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    across = links.join(side("a"), "a").join(side("b"), "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct()
    return stash(components(across).select(F.col("node").alias("old"), F.col("root").alias("new")), "moves")


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != "root"]
    return rows.join(moves, rows["root"] == moves["old"], "left").select(*kept, F.coalesce("new", "root").alias("root"))


def _key(id_col: Column, text_col: Column) -> dict[str, Column]:
    """What a row is told by: its id, whether it has none, and the SHA-256 of its text."""
    doc_id = id_col.cast("long")
    return {"id": F.coalesce(doc_id, F.lit(0)), "no_id": doc_id.isNull(), "th": F.unhex(F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256))}


def _labelled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(id, no_id, th, n, ck, root, low) of near_dedup's rows: set size, set digest (null without words), component and its smallest id."""
    key = _key(F.col(id_col), F.col(text_col))
    source = docs.select(*[c.alias(name) for name, c in key.items()], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    signed = stash(_signatures(source, width, bands, rows), "signatures")
    one = F.min(F.struct("no_id", "id", "th", "size")).alias("one")  # the text of one row serves for its class
    grouped = signed.filter("n > 0").groupBy("ck").agg(one, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stash(grouped.select("ck", "one.*", "n", "sig", "bands").withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "size", F.explode("bands").alias("band"))
    crowded = stash(banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band"), "buckets")
    open_ = stash(banded.join(crowded, "band").withColumn("root", F.col("node")), "open")
    wanted = stash(classes.select("node", "id", "no_id", "th").join(open_.select("node").distinct(), "node"), "wanted")
    rows_of = _among(source, wanted).groupBy("id", "no_id", "th").agg(F.first("body").alias("body"))
    texts = stash(rows_of.join(wanted, ["id", "no_id", "th"]).select("node", "body"), "texts")

    roots = wanted.select("node", F.col("node").alias("root"))
    for led in (True, False):
        if (led and not TURNS) or open_.isEmpty():
            continue
        groups, slim = (_led(open_), classes.select("node", "n", "sig")) if led else (_across(open_), classes.select("node", "n", "sig", "bands"))
        links = _links(groups, slim, texts, width, percent, miss)
        if not links.isEmpty():
            moves = _moves(links, roots)
            roots = stash(_moved(roots, moves), "roots")
            if led:
                open_ = _mixed(_moved(open_, moves))

    low = F.when(~F.col("no_id"), F.col("id"))
    node_root = stash(classes.join(roots, "node", "left").select("ck", low.alias("low"), F.coalesce("root", "node").alias("root")), "class-roots")
    lowest = stash(node_root.groupBy("root").agg(F.min("low").alias("low")), "lowest")
    found = stash(node_root.select("ck", "root").join(lowest, "root"), "found")
    return signed.select("id", "no_id", "th", "n", "ck").join(found, "ck", "left")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.

    Words are what stands between ASCII white space, with A-Z lower-cased. A text of fewer words is one shingle; a text
    without words (null, empty) has none and is linked with nothing. Equal sets, by their SHA-256, are one class from the start.
    Classes that share a band of their signatures are candidates: first each class with TURNS leaders of its band buckets; then, in
    buckets that still have several components, all pairs across these. Candidates are dropped when the bytes of their signatures,
    compared in batches, leave a link a posterior probability under ``miss``; the others are compared on the full sets of their
    texts, in groups of at most two parts of a bucket, which hold about PART_BYTES each (or one longer text). Joins by band or
    leader, of rows without texts, leave keys with very many rows to adaptive execution, which splits them.

    Returns doc_id, n_shingles, component_id (smallest id of the component; nulls aside), kept (doc_id =
    component_id), one row for each input row. Repeated rows are alike; a null id has the component of its set. Other columns
    are not carried; an empty table gives an empty result. ``options``: id_col, text_col, width, percent, bands, rows (of a band), miss.
    """
    doc_id = F.when(~F.col("no_id"), F.col("id"))
    rows = _labelled(docs, **options).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("ck").isNull(), doc_id).otherwise(F.col("low")).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, of the smallest id (a row with an id, if there is one); all columns, whatever their names.

    Of rows of that id in one component the text of the smallest SHA-256 stays, and of rows that repeat it, one. Texts without words, null and
    empty ones among them, are in no component and all stay. An empty table gives an empty result.
    """
    rows = _labelled(docs, id_col=id_col, text_col=text_col, **options).filter("ck IS NOT NULL")
    keys = ["id", "no_id", "th"]
    rows = stash(rows.groupBy("root", *keys).agg(F.count("*").alias("times")), "keys")
    best = stash(rows.groupBy("root").agg(F.min(F.struct("no_id", "id", "th", "times")).alias("k")).select("k.*"), "best")
    gone = rows.select(*keys).join(best, keys, "left_anti")
    repeated = best.filter("times > 1")
    same = lambda other: [c == other[name] for name, c in _key(docs[id_col], docs[text_col]).items()]
    kept = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same(repeated), "left_anti").union(kept.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col]))
