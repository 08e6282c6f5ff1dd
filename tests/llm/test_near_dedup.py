import random

import numpy as np
import pytest

from citeloom.llm.components import components
from citeloom.llm.near_dedup import drop_near_duplicates, least_matches, likely, near_dedup, numbered, shingle_hashes, shingle_set, signature


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[j:] for j in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 8, 40, 120, 300]))
        for _ in range(rnd.choice([1, 2, 5, 20])):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 8))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, rnd.choice([" ", "\n", "\t "]).join(w.upper() if rnd.random() < 0.1 else w for w in copy)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    rows = corpus(width) + [(5000, None), (5001, ""), (5002, "  \n"), (None, "w1 w2 w3 w4 w5 w6"), (6000, "w1 w2 w3 w4 w5 w6"), (6000, "w1 w2 w3 w4 w5 w6")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, node int, band int")
    got = sorted((tuple(r) for r in near_dedup(df, width=width).collect()), key=str)
    assert got == brute(rows, width, 80)


def test_signatures_estimate_similarity():
    rnd = random.Random(1)
    for share in (0.5, 0.8, 0.95):
        words = [str(rnd.random()).encode() for _ in range(3000)]
        a, b = shingle_hashes(words[:2000], 1), shingle_hashes(words[: int(2000 * share)], 1)
        assert abs((signature(a, 2000) == signature(b, 2000)).mean() - share) < 0.04


def test_pruning_keeps_pairs_at_the_threshold_and_drops_others():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 256, (20000, 160), np.uint8)
    at = np.where(rnd.random(x.shape) < 0.8, x, rnd.integers(0, 256, x.shape, np.uint8))
    far = np.where(rnd.random(x.shape) < 0.4, x, rnd.integers(0, 256, x.shape, np.uint8))
    assert likely(x, at, 80, 1e-6, 16).mean() > 0.9995
    assert likely(x, far, 80, 1e-6, 16).mean() < 0.01
    assert least_matches(160, 80, 1e-6, 16)[-1][1] < 128


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_long_paths_and_stars(spark, small):
    rnd = random.Random(2)
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(900, 990)]
    pairs = path + star + [(5000, 5000), (3000, 2000), (2000, 3000), (3000, 2000)]
    rnd.shuffle(pairs)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long"), small).collect())
    want = {i: 0 for i in range(61)} | {i: 900 for i in range(900, 990)} | {1000: 900, 3000: 2000, 2000: 2000}
    assert got == want


def test_empty_table_and_dropping(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 1), (2, "A b c d e f", 2), (3, "z", 3), (4, None, 4)], "doc_id long, text string, kept int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_all_pairs_across_components_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr("citeloom.llm.near_dedup.TURNS", 0)
    monkeypatch.setattr("citeloom.llm.near_dedup.PART", 7)
    rows = corpus(31)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dedup(df, width=2).collect()), key=str) == brute(rows, 2, 80)


def test_dropping_repeated_rows_and_ids(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(near), 1), (3, " ".join(near), 2), (7, " ".join(near[:-1]), 3), (7, "other words", 4), (3, " ".join(near).upper(), 5), (None, " ".join(near), 6), (None, "alone here", 7), (None, "alone here", 8), (9, " ", 9), (9, " ", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = drop_near_duplicates(df, width=2).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()[:5]) for r in got) == [(0, "alone"), (3, "w0 w1"), (7, "other"), (9, " "), (9, " ")]


def test_numbers_of_shingles_are_those_of_their_words():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abc", k=rnd.randrange(1, 9))).encode() for _ in range(60)]
    for width in (1, 2, 5):
        ids, starts = numbered(texts, width)
        sets = [ids[i:j].tolist() for i, j in zip(starts, starts[1:])]
        plain = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.split() for t in texts)]
        assert [len(s) for s in sets] == [len(s) for s in plain] == [shingle_set(t.split(), width)[0] for t in texts]
        assert all(len(set(sets[i]) & set(sets[j])) == len(plain[i] & plain[j]) for i in range(60) for j in range(60))
        digests = [shingle_set(t.split(), width)[1] for t in texts]
        assert all((digests[i] == digests[j]) == (plain[i] == plain[j]) for i in range(60) for j in range(60))


def test_a_very_long_text_and_its_copy(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1000])), (3, "x " * 500_000), (4, "x " * 10), (5, " ".join(words[: len(words) // 2]))]
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
