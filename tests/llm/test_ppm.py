import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from citeloom.llm import ppm, words
from citeloom.llm.ppm import EDGE, ppm_scores


def brute(rows, alphabet):
    """Word counts and PPM, symbol by symbol, in dictionaries."""
    low = [(d, (t or "").encode().lower()) for d, t in rows]
    train = [b for d, b in low if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    words = Counter(w for b in train for w in b.split())
    ends = len(train)
    total, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    ctx = [defaultdict(Counter) for _ in range(4)]
    for b in train:
        x = bytes([EDGE] * 3) + b + bytes([EDGE])
        for i in range(3, len(x)):
            for k in range(4):
                ctx[k][x[i - k : i]][x[i]] += 1
    frequent = [s for s, _ in sorted(ctx[0][b""].items(), key=lambda x: (-x[1], x[0]))[:alphabet]]
    if EDGE not in frequent:
        frequent = [EDGE] + frequent[: alphabet - 1]

    def prob(x, i):
        order = 3 if all(s in frequent for s in x[i - 3 : i]) else 2
        free, p = set(range(256)), 1.0
        for k in range(order, -1, -1):
            c = {s: n for s, n in ctx[k].get(x[i - k : i], {}).items() if s in free}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if x[i] in c:
                return p * c[x[i]] / (n + d)
            p *= d / (n + d)
            free -= set(c)
        return p / len(free)

    out = []
    for d, b in low:
        x = bytes([EDGE] * 3) + b + bytes([EDGE])
        toks = [words[w] for w in b.split()] + [ends]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in toks)
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        out.append((d, held, len(toks), sum(c > 0 for c in toks), total, base, sum(math.log10(prob(x, i)) for i in range(3, len(x)))))
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train string")
    got = sorted((tuple(r) for r in ppm_scores(df).collect()), key=str)
    want = sorted(brute(rows, ppm.ALPHABET), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5), (g, w)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["The", "cat", "l'été", "x1", "Ünder", "日本", "~", "qq" * 20]
    rows = [(i, rnd.choice([" ", "\n", "\t\t"]).join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(80)]
    rows += [(100, "".join(chr(c) for c in range(32, 255)) * 3), (None, None), (5, ""), (5, "repeat"), (5, "repeat"), (10**12, "\x00 ½ new")]
    compare(spark, rows)


def test_nothing_learned_and_empty(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    compare(spark, [(held, "some text")])
    assert ppm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rare_bytes_keep_contexts_of_three(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choices([chr(c) for c in range(33, 127)] + list("жшщ日本語"), k=60)) + " 4711 wörld, жизнь" * 5) for i in range(60)]
    low = brute(rows, 256)
    assert max(abs(a[-1] - b[-1]) for a, b in zip(low, brute(rows, 40))) > 1
    compare(spark, rows)
    got = {r.doc_id: r.score for r in ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(math.isclose(got[w[0]], w[-1], rel_tol=1e-5) for w in low)


def test_long_texts(spark):
    text = "The cat sat, жизнь and été. " * 10_000
    compare(spark, [(1, text), (2, text[:280]), (3, "other words"), (4, None)])
    longer = spark.createDataFrame([(1, text * 12), (2, "The cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm_scores(longer).collect()}
    assert got[1].n_tokens == 6 * 120_000 + 1 and got[1].score < 0


def test_words_of_every_chunk_in_many_blocks(spark, monkeypatch):
    """A chunk for each text, and blocks of two partitions or two chunks: common words, and codes, have many blocks."""
    monkeypatch.setattr(ppm, "_CHUNK_BYTES", 40)
    monkeypatch.setattr(ppm, "block_of", lambda chunk: words.block_of(chunk, 2, 2))
    rnd = random.Random(4)
    rows = [(i, "the жизнь " * rnd.randrange(1, 4) + rnd.choice(["cat", "été", "日本"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    source = df.select("doc_id", F.col("text").cast("binary").alias("body"), F.lit(True).alias("train"))
    cells = words.dictionaries(source, ppm._lower_words, chunk_bytes=40).select("chunk", words.block_of(F.col("chunk"), 2, 2).alias("block")).distinct().collect()
    members = Counter(c.block for c in cells)
    assert len(members) > 3 and max(members.values()) <= 4 and len({c.chunk for c in cells}) == len(cells)
    compare(spark, rows)
