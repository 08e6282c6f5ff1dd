import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import bm25, evaluation, ranking, vectors

DOCS = [("d1", "", "heart heart failure"), ("d2", "heart", "attack"), ("d3", "", "lung cancer"), ("d4", "", "heart heart heart disease study")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "pmid string, title string, abstract string")


def test_scores_equal_a_hand_computation(spark, docs):
    bags = {d: (t + " " + a).split() for d, t, a in DOCS}
    avg = sum(map(len, bags.values())) / 4
    want = {}
    for d, bag in bags.items():
        for term in {"heart", "study"}:
            df, tf = sum(term in b for b in bags.values()), bag.count(term)
            if tf:
                want[d] = want.get(d, 0) + math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / avg))
    asked = spark.createDataFrame([("q", "Heart heart study")], "query_id string, question string")
    got = bm25.search(bm25.Index.build(docs), asked, 10).collect()
    assert {r.pmid: pytest.approx(r.score) for r in got} == want
    assert [r.pmid for r in sorted(got, key=lambda r: r.rank)] == sorted(want, key=lambda d: (-round(want[d], 9), d))


def test_saved_index_and_no_hits(spark, docs, tmp_path):
    index = bm25.Index.build(docs)
    index.save(str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", "lung"), ("none", "zzz"), ("empty", "")], "query_id string, question string")
    rows = lambda i: sorted(map(tuple, bm25.search(i, asked, 5).collect()))
    assert rows(bm25.Index.load(spark, str(tmp_path / "i"))) == rows(index)
    assert {r[0] for r in rows(index)} == {"q"}


def ranking_of(spark, rows):
    return spark.createDataFrame([(q, p, r + 1) for q, ps in rows for r, p in enumerate(ps)], "query_id string, pmid string, rank int")


def test_fusion_and_reranking(spark):
    a, b = ranking_of(spark, [("q", ["x", "y", "z"])]), ranking_of(spark, [("q", ["y", "w"])])
    got = {r.pmid: (r.rank, r.score) for r in ranking.reciprocal_rank_fusion([a, b], 10).collect()}
    assert got["y"] == (1, pytest.approx(1 / 62 + 1 / 61)) and got["x"][0] == 2 and set(got) == {"x", "y", "z", "w"}
    with pytest.raises(ValueError):
        ranking.reciprocal_rank_fusion([], 3)
    scored = a.withColumn("rerank_score", F.when(F.col("pmid") == "z", 5.0).otherwise(1.0))
    order = lambda w: [r.pmid for r in ranking.rerank(scored, 10, weight=w).orderBy("rank").collect()]
    assert order(0.0) == ["z", "x", "y"] and order(50.0) == ["x", "y", "z"]


def test_metrics(spark):
    hits = ranking_of(spark, [("q1", list("abcde")), ("q2", list("abc"))])
    qrels = spark.createDataFrame([("q1", "b"), ("q1", "d"), ("q2", "z")], "query_id string, pmid string")
    m = evaluation.metrics(hits, qrels, (1, 3)).first()
    gain = 1 / math.log2(3) + 1 / math.log2(5)
    assert (m.n_queries, m.recall_at_1, m.recall_at_3, m.mrr) == (2, 0, 0.25, 0.25)
    assert m.ndcg == pytest.approx(gain / (1 + 1 / math.log2(3)) / 2)
    assert [r.query_id for r in evaluation.misses(hits, qrels, 5).collect()] == ["q2"]


def points(spark, n, dim, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(str(i), i, v.tolist()) for i, v in enumerate(x)], "pmid string, vec_id long, vector array<double>")


def test_inverted_file_with_all_cells_is_exact(spark):
    x, p = points(spark, 120, 8, 1)
    asked = p.filter("vec_id < 6").select(F.col("pmid").alias("query_id"), "vector")
    exact = vectors.block_top(asked, p, 5)
    rows = lambda df: sorted((r.query_id, r.rank, r.pmid) for r in df.collect())
    want = sorted((str(q), i + 1, str(j)) for q in range(6) for i, j in enumerate(np.argsort(-np.round(x @ x[q], 9), kind="stable")[:5]))
    assert [(q, r) for q, r, _ in rows(exact)] == [(q, r) for q, r, _ in want] and rows(exact)[0][2] == want[0][2]
    index = vectors.InvertedFile.build(p, vectors.seeds(p, 6))
    assert rows(index.search(asked, 5, 6)) == rows(exact)
    few = vectors.recall(index.search(asked, 5, 2), exact, 5).first()[0]
    assert 0 < few <= 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_small_world_recall(seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    world = vectors.SmallWorld(x, m=8, breadth=60)
    hits = 0
    for q in range(40):
        found = [j for _, j in world.search(x[q], 10)]
        assert found[0] == q
        hits += len(set(found) & set(np.argsort(-(x @ x[q]))[:10].tolist()))
    assert hits >= 0.9 * 400


def test_kmeans_recovers_clusters(spark):
    rnd = random.Random(1)
    rows = [(str(i), i, [10.0 * (i % 3) + rnd.random() * 0.1, rnd.random() * 0.1]) for i in range(60)]
    p = spark.createDataFrame(rows, "pmid string, vec_id long, vector array<double>")
    centroids, assigned = vectors.kmeans(p, vectors.spread_seeds(p, 3))
    cells = {r.pmid: r.cell for r in assigned.collect()}
    assert len({cells[str(i)] for i in range(3)}) == 3 and all(cells[str(i)] == cells[str(i % 3)] for i in range(60))
    assert centroids.count() == 3
    with pytest.raises(ValueError):
        vectors.spread_seeds(p, 61)


def test_embedding_is_unit_or_zero(spark):
    got = {r.pmid: np.array(r.vector) for r in vectors.embed(spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", "TWO one, two")], "pmid string, text string")).collect()}
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-12 and (got["a"] == got["c"]).all() and not got["b"].any() and len(got["b"]) == 64


def test_trained_inverted_file_recall(spark):
    from citeloom.plans import search

    found, truth = (f(spark, "/root/testdata/sf0.1") for f in (search.ivf_trained_search, search.dense_topk))
    assert vectors.recall(found, truth, 10).first()[0] >= 0.9


def test_fixed_cells_and_stored_graphs_find_their_hits(spark):
    from citeloom.plans import search

    d = "/root/testdata/sf0.1"
    assert search.ann_recall(spark, d).first()[0] >= 0.9
    graph = search._graph(spark, d)
    assert graph.centroids.count() >= 4
    assert vectors.recall(search.hnsw_search(spark, d), search.dense_topk(spark, d), 10).first()[0] >= 0.9


def cost(p, seeds):
    return vectors.assign(p, seeds).agg(F.sum("distance")).first()[0]


def test_parallel_seeds_cost_what_sequential_ones_do(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    centers = rnd.normal(size=(12, 6)) * 5
    x = np.vstack([c + rnd.normal(size=(50, 6)) for c in centers])
    p = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "pmid string, vector array<double>")

    def sequential(seed):
        g = np.random.default_rng(seed)
        chosen = [int(g.integers(len(x)))]
        gap = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < 12:
            chosen.append(int(g.choice(len(x), p=gap / gap.sum())))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        return gap.sum()

    mean = np.mean([sequential(s) for s in range(10)])
    seeds = vectors.spread_seeds(p, 12)
    assert sorted(r["cell"] for r in seeds.collect()) == list(range(12))
    assert cost(p, seeds) <= 1.1 * mean
    assert sorted(map(tuple, seeds.collect())) == sorted(map(tuple, vectors.spread_seeds(p.repartition(5), 12).collect()))
    monkeypatch.setattr(vectors, "GROUP", 16)  # several groups of candidates
    assert vectors.spread_seeds(p, 12).count() == 12
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(9)], "pmid string, vector array<double>")
    assert vectors.spread_seeds(same, 4).count() == 4


def test_empty_cells_are_seeded_anew(spark):
    p = spark.createDataFrame([(str(i), [float(i // 10) * 10 + (i % 10) * 0.1, 0.0]) for i in range(40)], "pmid string, vector array<double>")
    start = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1e6, 0.0]), (2, [2e6, 0.0]), (3, [3e6, 0.0])], "cell int, vector array<double>")
    centroids, assigned = vectors.kmeans(p, start)
    assert centroids.count() == 4 and sorted(r["count"] for r in assigned.groupBy("cell").count().collect())[0] > 0
    assert assigned.select("cell").distinct().count() == 4


def test_graph_is_stored_searched_and_grown(spark, tmp_path):
    x, p = points(spark, 400, 12, 3)
    path = str(tmp_path / "g")
    graph = vectors.Graph.build(p.filter("vec_id < 300"), path, shard_rows=100, m=8, breadth=60)
    asked = p.filter("vec_id % 10 = 0").select(F.col("pmid").alias("query_id"), "vector")
    exact = lambda below: vectors.block_top(asked, p.filter(f"vec_id < {below}"), 10)
    assert vectors.recall(graph.search(asked, 10), exact(300), 10).first()[0] >= 0.9
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "g" / "nodes").rglob("*.parquet")}
    grown = graph.insert(p.filter("vec_id >= 300 OR vec_id < 5"), path, m=8, breadth=60)
    assert grown.nodes.count() == 400 and grown.nodes.select("pmid").distinct().count() == 400
    assert vectors.recall(grown.search(asked, 10, probes=4), exact(400), 10).first()[0] >= 0.9
    one = p.filter("vec_id = 399").select(F.lit("new").alias("pmid"), "vector")
    before = {f.parent.name: f.name for f in (tmp_path / "g" / "nodes").rglob("*.parquet")}
    grown = grown.insert(one, path, m=8, breadth=60)
    after = {f.parent.name: f.name for f in (tmp_path / "g" / "nodes").rglob("*.parquet")}
    assert sum(before[k] != after[k] for k in before) == 1 and untouched
    hit = grown.search(one.select(F.lit("q").alias("query_id"), "vector"), 2).collect()
    assert {r["pmid"] for r in hit} == {"new", "399"}


def test_search_by_bounds_is_the_ranking_of_all_scores(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = spark.createDataFrame([(str(i), "t", " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for i in range(400)] + [("c1", "t", "w50 w51"), ("c2", "t", "w50 w51"), ("e", "", "")], "pmid string, title string, abstract string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(30)] + [("none", "zz"), ("blank", ""), ("null", None)], "query_id string, question string")
    index = bm25.Index.build(docs)
    for k in (1, 7, 1000):
        want = ranking.top(bm25.scores(index, asked), k)
        rows = lambda df: sorted((r.query_id, r["rank"], r.pmid, round(r.score, 9)) for r in df.collect())
        assert rows(bm25.search(index, asked, k)) == rows(want)
    assert bm25.search(bm25.Index.build(docs.limit(0)), asked, 5).count() == 0 and bm25.search(index, asked.limit(0), 5).count() == 0


def test_ranks_of_own_candidates_are_those_of_the_whole_search(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    b = rnd.standard_normal((300, 6))
    b[40:90] = b[40]  # copies, which tie
    b[100:110] = 0
    a = b + rnd.standard_normal((300, 6)) * rnd.choice([0.1, 1.5], (300, 1))
    rows = [(str(i), x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    pairs = spark.createDataFrame(rows, "pmid string, asked array<double>, vector array<double>")
    near = vectors.block_top(pairs.select(F.col("pmid").alias("query_id"), F.col("asked").alias("vector")), pairs.select("pmid", "vector"), 5)
    want = sorted((r["query_id"], r["rank"]) for r in near.filter("query_id = pmid").collect())
    sent = []
    assert 50 < len(want) < 250 and sorted(map(tuple, vectors.own_within(pairs, 5).collect())) == want
    monkeypatch.setattr(vectors, "GRID", 20)  # sixteen slices in five rounds, queries in blocks
    monkeypatch.setattr(vectors, "SLICE", 7)
    monkeypatch.setattr(vectors, "settled", lambda df: sent.append(kept(df)) or sent[-1])
    kept = lambda df: spark.createDataFrame(df.toArrow().to_pylist(), df.schema)
    assert sorted(map(tuple, vectors.own_within(pairs, 5).collect())) == want
    left = [df.count() for df in sent]
    assert len(left) == 5 and left == sorted(left, reverse=True) and left[-1] == len(want) < left[0]
    assert vectors.own_within(pairs.limit(0), 5).count() == 0
