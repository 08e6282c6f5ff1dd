import numpy as np
from pyspark.sql import functions as F

from citeloom.llm.nearest import nearest, tile_best


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = min(v, good[i]) if i in good else v
    out = []
    for q in good:
        if is_query(q):
            scores = sorted((-float(np.dot(np.float64(good[q]), np.float64(x))), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert abs(g[3] - w[3]) < 1e-9 and (g[2] == w[2] or any(abs(x[3] - w[3]) < 1e-9 and x[2] == g[2] for x in want if x[0] == g[0])), (g, w)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.float32(rnd.normal(size=(600, 16)) * rnd.choice([0.01, 1, 50], (600, 1))))]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    rows += [(2000, None), (2010, []), (2020, [0.0] * 16), (2030, [None] + [1.0] * 15), (2040, [float("nan")] * 16), (2050, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (2060, [1.0, 2.0]), (2070, [2.0, -1.0]), (5, rows[7][1]), (5, rows[7][1])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "vec_id long, embedding array<double>, tile string")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0, 7, tile=100, block=40).collect())
    same(got, brute(rows, lambda i: i % 10 == 0, 7))


def test_ties_go_to_the_smaller_id():
    x = np.array([[1.0, 0], [1.0, 0], [0.5, 0], [1.0, 0]])
    (ids, scores), = tile_best(np.array([[2.0, 0.1]]), np.array([9]), x, np.array([8, 3, 5, 4]), 2)
    assert ids.tolist() == [3, 4] and scores.tolist() == [2.0, 2.0]


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nearest(df.limit(0), F.lit(True)).collect() == []


def test_repeated_vectors_of_64_dimensions_tie_exactly(spark):
    rnd = np.random.default_rng(5)
    base = np.float32(rnd.normal(size=(40, 64)))
    rows = [(int(i), [float(c) for c in base[k]]) for i, k in zip(rnd.permutation(1200), rnd.integers(0, 40, 1200))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    of = dict(rows)
    for tile in (50, 5000):
        got = nearest(df, F.col("vec_id") % 20 == 0, 40, tile=tile, block=30).collect()
        lists = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            lists.setdefault(r.query_id, []).append(r)
        assert len(lists) == 60
        for q, best in lists.items():
            score = {tuple(of[r.vec_id]): r.score for r in best}
            assert all(score[tuple(of[r.vec_id])] == r.score for r in best)  # equal vectors, equal scores
            exact = {i: float(np.add.accumulate(np.float64(of[q]) * np.float64(v))[-1]) for i, v in rows if i != q}
            assert [(r.vec_id, r.score) for r in best] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:40]
