"""Best-fit-decreasing sharding of indivisible groups."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_within, stash

#: A group with one of so many parts of all rows or more, of which there are as many at most, meets its rows by a broadcast.
HOT_PARTS = 10_000


class _Node:
    __slots__ = ("key", "bins", "left", "right", "height")

    def __init__(self, key: int, b: int):
        self.key, self.bins, self.left, self.right, self.height = key, [b], None, None, 1


def _height(n: _Node | None) -> int:
    return n.height if n else 0


def _fix(n: _Node) -> _Node:
    """Height of ``n``; rotate where its sides differ by more than one."""
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _turn(n.left, "right", "left")
        return _turn(n, "left", "right")
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _turn(n.right, "left", "right")
        return _turn(n, "right", "left")
    n.height = 1 + max(_height(n.left), _height(n.right))
    return n


def _turn(n: _Node, up: str, down: str) -> _Node:
    top = getattr(n, up)
    setattr(n, up, getattr(top, down))
    setattr(top, down, n)
    n.height = 1 + max(_height(n.left), _height(n.right))
    top.height = 1 + max(_height(top.left), _height(top.right))
    return top


class CapacityTree:
    """AVL tree of bins by remaining capacity."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: int, b: int) -> None:
        def at(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key, b)
            if key == n.key:
                n.bins.append(b)
                return n
            if key < n.key:
                n.left = at(n.left)
            else:
                n.right = at(n.right)
            return _fix(n)

        self.root = at(self.root)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining, bin) of the tightest bin with room for ``need``."""
        n, best = self.root, None
        while n:
            if n.key >= need:
                n, best = n.left, n
            else:
                n = n.right
        if best is None:
            return None
        key, b = best.key, best.bins.pop()
        if not best.bins:
            self.root = self._without(self.root, key)
        return key, b

    def _without(self, n: _Node, key: int) -> _Node | None:
        if key < n.key:
            n.left = self._without(n.left, key)
        elif key > n.key:
            n.right = self._without(n.right, key)
        elif n.left is None or n.right is None:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key, n.bins = least.key, least.bins
            n.right = self._without(n.right, least.key)
        return _fix(n)


def fit_classes(classes: list[tuple[int, int]], capacity: int, limit: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """Best-fit-decreasing of (size, how many items) by falling size: (size, number of the first item, bin) of runs, and the number of bins.

    An item enters the bin with the least remaining capacity that holds it, or a new one; an item larger than ``capacity`` gets a
    bin of its own. The bin that an item entered is the tightest for the next of its size as long as it holds it, so a
    run of them enters at once. Stops when there are more than ``limit`` bins.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in classes:
        first = 0
        while first < count:
            found = tree.take(size)
            left, b = found if found else (max(capacity, size), bins)
            bins += not found
            if limit is not None and bins > limit:
                return runs, bins
            k = min(count - first, left // size)
            runs.append((size, first, b))
            first += k
            tree.add(left - k * size, b)
    return runs, bins


def fill_classes(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, number of the first item, shard) of (size, how many items) in ``shards`` shards of near equal size.

    An item above the mean of what is left has a shard of its own; the others go by fit_classes under the smallest capacity, to
    within a ten-thousandth, with which they need no more shards than there are.
    """
    items = sorted(classes, reverse=True)
    runs, left, total, skipped = [], shards, sum(s * c for s, c in items), {}
    while left > 1 and items and items[0][0] * left > total:
        size, count = items[0]
        left -= 1
        runs.append((size, skipped.get(size, 0), left))
        skipped[size] = skipped.get(size, 0) + 1
        total -= size
        items[0] = (size, count - 1)
        if count == 1:
            items.pop(0)
    if not items:
        return runs
    low = max(-(-total // left), items[0][0])
    high = low + items[0][0]
    packed, bins = fit_classes(items, low, left)
    if bins > left:
        packed, bins = fit_classes(items, high, left)
        while bins > left:
            high *= 2
            packed, bins = fit_classes(items, high, left)
        while high - low > max(1, low // 10_000):
            mid = (low + high) // 2
            tried, bins = fit_classes(items, mid, left)
            if bins <= left:
                packed, high = tried, mid
            else:
                low = mid
    return runs + [(size, first + skipped.get(size, 0), b) for size, first, b in packed]


def _placed(sizes: Iterable[tuple[object, int]], runs: list[tuple[int, int, int]]) -> dict:
    """Bin of each item, those of a size in the order of their names."""
    of: dict[int, list[tuple[int, int]]] = {}
    for size, first, b in sorted(runs):
        of.setdefault(size, []).append((first, b))
    place, seen = {}, Counter()
    for item, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        starts = of[size]
        place[item] = starts[bisect_right(starts, (seen[size], float("inf"))) - 1][1]
        seen[size] += 1
    return place


def best_fit_decreasing(sizes: Iterable[tuple[object, int]], capacity: int) -> tuple[dict, int]:
    """Bin of each item, by fit_classes, and the number of bins; ties go by the item."""
    items = list(sizes)
    runs, bins = fit_classes(sorted(Counter(s for _, s in items).items(), reverse=True), capacity)
    return _placed(items, runs), bins


def fill_shards(sizes: list[tuple[object, int]], shards: int) -> dict:
    """Shard of each item, by fill_classes; ties go by the item."""
    return _placed(sizes, fill_classes(list(Counter(s for _, s in sizes).items()), shards))


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put documents into ``shards`` shards of near equal bytes; equal texts stay together.

    The size of a document is the UTF-8 bytes of its text (null: none) plus 1. Groups of equal texts
    (null and empty alike) are indivisible, and all of them go by best-fit-decreasing, by the bytes of the whole group. Groups of a
    size are interchangeable, so the driver has the sizes alone, and how many groups have each. Different sizes add up to no more than
    all bytes, so of B bytes there are fewer than sqrt(2 * B) sizes (14 million at 100 TB), however many groups. A group takes the place
    of its number among those of its size, in the order of their texts' SHA-256. A group larger than a mean shard makes its
    shard larger than the others.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in the shard, in
    order of a hash of the id), grown_shard (null: with one more shard, others would move as well). One row
    for each input row, with null or repeated ids too. Other columns are not carried; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("body")),
        "sizes",
    )
    groups = stash(rows.groupBy("body").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    classes = [(r["bytes"], r["c"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("c")).collect()]
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs: dict[int, list[tuple[int, int]]] = {}
    for size, first, b in sorted(fill_classes(classes, shards)):
        runs.setdefault(size, []).append((first, b))
    table = docs.sparkSession.createDataFrame([(size, [f for f, _ in r], [b for _, b in r]) for size, r in runs.items()], "bytes long, starts array<long>, bins array<int>")
    numbered = number_within(groups, ["bytes"], ["body"], "number", sum(c for _, c in classes))
    own = F.expr("element_at(bins, size(filter(starts, x -> x <= number)))")
    placed = stash(numbered.join(table, "bytes").select("body", "n", own.alias("shard")), "placed")
    hot = F.col("n") * HOT_PARTS >= F.lit(n)
    few = placed.filter(hot).select("body", F.col("shard").alias("own"))
    met = stash(rows.join(F.broadcast(few), "body", "left"), "met")
    rest = met.filter("own IS NULL").drop("own").join(placed.filter(~hot).select("body", "shard"), "body")
    every = met.filter("own IS NOT NULL").withColumnRenamed("own", "shard").unionByName(rest).select("rid", "doc_id", "size", "text_crc32", "shard")
    slots = number_within(stash(every, "sharded"), ["shard"], ["doc_id", "rid"], "slot", n)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
