import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from citeloom.llm import lexical
from citeloom.llm.lexical import ranked_search, term_counts, wand
from citeloom.llm.queries import op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    merged = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in merged.items():
        rows = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words if c[t])
            if s > 0 and d is not None:
                rows.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return out


def test_terms_in_slices(monkeypatch):
    text = "Été x2-Y2  Über_ALLES\x00\x7f　wide ÀÉ 日本 aB" * 50 + "Tail" * 40
    want = Counter(t.encode() for t in terms(text))
    for size in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(lexical, "SLICE", size)
        assert term_counts(text.encode()) == want
    assert term_counts(b"") == Counter() and term_counts(b" ,.") == Counter()


def test_wand_is_exact():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.choice([3, 40, 400])
        lists = []
        for _ in range(rnd.randint(0, 12)):
            docs = sorted(rnd.sample(range(n), rnd.randint(1, n)))
            lists.append((docs, [rnd.choice([1, 2, 3, 50]) for _ in docs], rnd.choice([1, 2, 7, 100])))
        sums = Counter()
        for docs, values, w in lists:
            for d, v in zip(docs, values):
                sums[d] += v * w
        for k in (1, 5, 20):
            assert wand(lists, k) == sorted(((s, d) for d, s in sums.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_wand_skips_documents():
    scored = []

    class Seen(list):
        def __getitem__(self, i):
            scored.append(i)
            return list.__getitem__(self, i)

    n = 50_000
    common, rare = (list(range(n)), Seen([1] * n), 1), ([5, 7, 9] + list(range(20, 40)), [9] * 23, 1000)
    best = wand([common, rare], 20)
    assert [d for _, d in best] == [5, 7, 9, *range(20, 37)] and len(scored) < 100


WORDS = "the of and a in on é über x1 rare alpha beta gamma delta Zulu YANKEE 日本".split()


def corpus(seed, n):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i * 3, " ".join(rnd.choices(WORDS, weights, k=rnd.choice([0, 1, 5, 30, 200])))) for i in range(n)]


ODD = [(None, "no id rare rare"), (4, None), (5, ""), (7, ",.!"), (10, "rare Zulu"), (10, "rare Zulu"), (11, "rare ZULU"), (13, "the " * 3000), (-2, "rare zulu")]
ITEMS = [(0, "the rare ZULU"), (1, "alpha alpha beta, Zulu!"), (2, None), (3, ""), (4, "unseen words only here"), (5, "日本 é x1"), (6, "the of and a in on é über x1 rare alpha beta gamma delta zulu yankee"), (0, "delta"), (None, "the")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark, tmp_path):
    docs = corpus(1, 300) + ODD
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("shard", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert rows(op12_ranked_search(spark, str(tmp_path))) == sorted(brute(docs, ITEMS))


def test_shards_blocks_and_rounds_of_merging(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FAN", 4)
    docs, items = corpus(2, 200), [i for i in ITEMS if i[0] is not None]
    d, q = spark.createDataFrame(docs, "key int, body string"), spark.createDataFrame(items, "q long, words string")
    got = ranked_search(d, q, 7, id_col="key", text_col="body", item_col="q", item_text_col="words", postings=100, block=2)
    assert rows(got) == sorted(brute(docs, items, 7))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(none, items).count() == 0
    assert ranked_search(some, items.limit(0)).count() == 0
    assert rows(ranked_search(some, items)) == brute([(1, "a b")], [(1, "a")])
