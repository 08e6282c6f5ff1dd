"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash

#: Bytes in a block.
BLOCK_BYTES = 4096


def _named(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct ``columns`` of ``keys`` with an integer ``name``, one for each, stored.

    Each hash partition is sorted, so that a row's number in it, and with it the name, is the
    same when a lost task runs again.
    """
    distinct = keys.select(*columns).distinct()
    return stash(distinct.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id()), label)


def name_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Give each text one integer identity that only equal texts share.

    A text (null: empty), with A-Z lower-cased, is cut into blocks of ``block_bytes`` bytes.
    Distinct blocks are sorted and named by integers; then adjacent pairs of names are named, level
    by level, until each document has one name. Names come from whole contents, so there is
    no collision. Occurrences find their block's name by ``key``, a hash; where two
    distinct blocks share a hash, which the table of names shows, they are joined by content.

    Returns ``(rows, identity)``, both stored: rows(rid, doc_id, text_sha256), one for each input
    row with a number of its own, and identity(rid, level, name).
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("body"))
    n = F.greatest(F.ceil(F.octet_length("body") / F.lit(block_bytes)), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    named = stash(
        raw.select(F.explode(blocks).alias("block")).distinct().sortWithinPartitions("block").select(key(F.col("block")).alias("h"), F.monotonically_increasing_id().alias("name")),
        "block-names",
    )
    rows = stash(
        raw.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("body", 256).alias("text_sha256"), F.transform(blocks, lambda b: key(b)).alias("hs")),
        "rows",
    )
    level = rows.select("rid", F.posexplode("hs").alias("pos", "h"), F.size("hs").alias("n"))
    shared = named.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    if shared.isEmpty():
        level = level.join(named, "h").select("rid", "pos", "n", "name")
    else:
        level = _by_content(raw, rows, blocks, named, level, shared, key)
    depth, done = 0, []
    level = stash(level, "level")
    while True:
        done.append(level.filter("n = 1").select("rid", F.lit(depth).alias("level"), "name"))
        level = level.filter("n > 1")
        if level.isEmpty():
            break
        half = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = stash(
            level.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(F.max(half[0]).alias("a"), F.coalesce(F.max(half[1]), F.lit(-1)).alias("b")),
            "pairs",
        )
        names = _named(pairs, ["a", "b"], "pair-names")
        level = stash(pairs.join(names, ["a", "b"]).select("rid", "pos", "n", "name"), "level")
        depth += 1
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    return rows.select("rid", "doc_id", "text_sha256"), identity


def _by_content(raw: DataFrame, rows: DataFrame, blocks: Column, named: DataFrame, level: DataFrame, shared: DataFrame, key) -> DataFrame:
    """Names of occurrences where some hashes belong to several blocks: those go by content.

    Names are dealt anew over the blocks that clash, by content; they continue below zero, apart
    from all others.
    """
    sha = F.sha2("body", 256)
    contents = raw.select(sha.alias("text_sha256"), F.posexplode(blocks).alias("pos", "block")).withColumn("h", key(F.col("block"))).join(shared, "h", "left_semi").distinct()
    contents = stash(contents, "clashing")
    again = _named(contents, ["block"], "clashing-names").select("block", (-F.col("name") - 2).alias("name"))
    by_text = contents.join(again, "block").select("text_sha256", "pos", "name")
    clear = level.join(shared, "h", "left_anti").join(named, "h").select("rid", "pos", "n", "name")
    clash = level.join(shared, "h", "left_semi").join(rows.select("rid", "text_sha256"), "rid").join(by_text, ["text_sha256", "pos"]).select("rid", "pos", "n", "name")
    return clear.unionByName(clash)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Which rows have equal texts, and which of them stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest id stays; among rows that repeat that id, exactly one does, and
    a null id is below all others. Returns a row for each input row: doc_id, keep_id (id of the
    row that stays; null if all ids of the group are), group_size long, kept boolean, text_sha256
    (of the text with A-Z lower-cased), rid. Other columns of ``docs`` are not carried; an empty table
    gives an empty result.
    """
    rows, identity = name_documents(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, key=key)
    rows = stash(rows.join(identity, "rid"), "identities")
    groups = stash(
        rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("last")),
        "groups",
    )
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("last.rid")).alias("kept"),
        "text_sha256",
        "rid",
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another's text; all its columns, whatever their names.

    Of each group of equal texts one row stays, of the largest id; of rows that repeat that id, any one. Null texts equal empty ones, and stay null where
    such a row stays. An empty table gives an empty result. The joins by a text's name have as hot a key as the commonest text; splitting skewed
    joins, which Spark does by itself, spreads it.
    """
    found = stash(exact_dedup(docs, id_col=id_col, text_col=text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("th")), "kept")
    ids = stash(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 OR NOT kept"), "ids")
    by_id = lambda other: docs[id_col].eqNullSafe(other["doc_id"])
    out = docs.join(ids, by_id(ids), "left_anti")
    repeated = ids.filter("n > 1")
    if repeated.isEmpty():
        return out
    name = "normal_text"
    while name in map(str.lower, docs.columns):
        name += "_"
    normal = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256))
    stay = found.filter("kept").join(repeated.select(F.col("doc_id").alias("r")), F.col("doc_id").eqNullSafe(F.col("r"))).select("doc_id", "th").distinct()
    again = docs.join(repeated, by_id(repeated), "left_semi").withColumn(name, normal)
    again = again.join(stay, again[id_col].eqNullSafe(stay["doc_id"]) & (again[name] == stay["th"]), "left_semi")
    return out.union(again.dropDuplicates([id_col, name]).drop(name))
