"""Connected components of a link table, by stars that grow and shrink in turn."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Distinct links that one task takes at most: some 40 MB of it.
SMALL = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node, stored so that the join after it can be split where a node has very many."""
    return stash(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of at most SMALL edges, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) of links(a, b): root is the smallest node that can be reached; both long.

    Alternates two steps until nothing changes: every node links its larger neighbours to the least
    one it knows, itself included; then every node links its smaller neighbours, and itself, to the least of
    those. Up to ``small`` distinct links, whose number is checked, take one task instead. Links of a node to itself and repeated links do no harm; nodes without links are absent. All stays in tables; a
    few rounds do, as the distance to a root about halves in each.
    """
    edges = stash(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= small:
        return _in_one_task(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both)
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large = stash(large, "large")
        m = _least(large)
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stash(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
