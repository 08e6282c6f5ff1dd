import hashlib
import random

from pyspark.sql import functions as F

from citeloom.llm.exact_dedup import drop_exact_duplicates, exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        x = (t or "").translate(LOWER)
        out.append((d, max((i for i in groups[x] if i is not None), default=None), len(groups[x]), hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("level", F.lit("x"))
    got = exact_dedup(df, **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    for key in {(r.keep_id, r.text_sha256) for r in got}:
        assert sum(r.kept for r in got if (r.keep_id, r.text_sha256) == key) == 1
    return got


def texts():
    rnd = random.Random(7)
    pieces = ["abc", "ABC", "abd", "Äb", "äb", "é", "x" * 9, " ", "\n", "İ", "ß"]
    return ["".join(rnd.choices(pieces, k=rnd.randrange(0, 12))) for _ in range(150)] + ["y" * 300, "y" * 301, "Y" * 300, "", "a", "A"]


def test_against_brute_force_with_small_blocks(spark):
    t = texts()
    run(spark, [(i, x) for i, x in enumerate(t + t[::3])] + [(1000, None), (1001, None)], block_bytes=4)


def test_hash_clashes_are_told_apart_by_content(spark):
    weak = lambda c: F.octet_length(c).cast("long") % 2
    t = texts()
    run(spark, list(enumerate(t + t[::4])), block_bytes=4, key=weak)


def test_repeated_and_null_ids(spark):
    run(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "z"), (None, None)])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_dropping_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, "a", 6), (3, None, None)], "doc_id long, text string, kept int")
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_dropping_repeated_rows_and_ids(spark):
    rows = [(2, "A", 1), (2, "a", 2), (2, "a", 3), (2, "other", 4), (1, "a", 5), (None, "z", 6), (None, "z", 7), (None, "a", 8), (None, None, 9), (4, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, normal_text int")
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect()) == [(0, "z"), (2, "a"), (2, "other"), (4, "")]


def test_a_text_of_many_blocks(spark):
    run(spark, [(1, "xyz" * 1_000_000), (2, "XYZ" * 1_000_000), (3, "xyz" * 999_999 + "xya"), (4, "é" * 700_001)])
