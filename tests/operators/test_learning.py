import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.operators import evaluation, learning, verification
from citeloom.operators.learning import Blocks, Classifier, Encoder, contrast, descend, fit_classifier, multinomial


def block(**columns):
    types = {"w": pa.float64(), "label": pa.int32(), "x": pa.list_(pa.float64()), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "terms": pa.list_(pa.int32())}
    return pa.StructArray.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], names=list(columns))


def check_gradient(gradient, params, rows):
    loss, grads = gradient(params, rows)
    rnd = np.random.default_rng(1)
    for k, v in params.items():
        for i in rnd.choice(v.size, min(8, v.size), replace=False):
            at, h = np.unravel_index(i, v.shape), 1e-6
            up, down = ({**params, k: v.copy()} for _ in range(2))
            up[k][at] += h
            down[k][at] -= h
            assert grads[k][at] == pytest.approx((gradient(up, rows)[0] - gradient(down, rows)[0]) / (2 * h), rel=1e-4, abs=1e-6)
    return loss


def test_gradients_by_differences():
    rnd = np.random.default_rng(0)
    lists = lambda n: [rnd.integers(0, 12, rnd.integers(1, 9)).tolist() for _ in range(n)]
    a = lists(6)
    rows = block(w=[1, 2, 1, 1, 3, 1.5], a=[*a[:5], a[0]], b=lists(6))
    assert check_gradient(contrast(12, 0.2), {"projection": rnd.standard_normal((12, 4))}, rows) > 0
    rows = block(w=[1, 0.5, 2], x=rnd.standard_normal((3, 2)).tolist(), label=[0, 2, 1], terms=[[1, 1, 4], [], [3]])
    check_gradient(multinomial(3, 5, 0.1), {"dense": rnd.standard_normal((3, 3)), "hashed": rnd.standard_normal((5, 3))}, rows)


def toy(spark, n=400, noise=0.1):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        label = rnd.choice([0, 0, 0, 1, 2])
        rows.append((i, [rnd.gauss(label * 100, 30), rnd.random()], label if rnd.random() > noise else rnd.randrange(3)))
    return spark.createDataFrame(rows, "id int, x array<double>, label int")


def test_rounds_are_those_of_one_machine_and_the_same_in_any_tasks(spark, monkeypatch):
    rows = toy(spark).select("x", "label", F.array().cast("array<int>").alias("terms"))
    rows = rows.unionByName(rows.limit(50))  # repeated rows
    gradient, start = multinomial(3, 0, 0.01), {"dense": np.zeros((3, 3))}
    blocks = Blocks.of(rows, steps=3, seed=5, block_rows=16)
    assert sum(blocks.weights.values()) == pytest.approx(450)
    got, losses = descend(blocks, start, gradient, epochs=2, rate=0.1)
    adam, want, seen = learning.Adam(0.1), start, []
    held = {s: [pa.array(r, type=None) for r in []] for s in blocks.weights}
    for s in blocks.weights:
        held[s] = [x for r in blocks.table.filter(F.col("slice") == s).select("rows").toArrow().column("rows").combine_chunks() for x in [r.values]]
    for _ in range(2):
        loss = 0.0
        for s in sorted(held):
            parts = [gradient(want, b) for b in held[s]]
            loss += sum(p[0] for p in parts)
            want = adam.step(want, {"dense": sum(p[1]["dense"] for p in parts) / blocks.weights[s]})
        seen.append(loss / 450)
    assert np.allclose(got["dense"], want["dense"], atol=1e-9) and np.allclose(losses, seen, atol=1e-9) and losses[1] < losses[0]
    monkeypatch.setattr(learning, "FAN", 2)
    spread = Blocks(blocks.table.repartition(7), blocks.weights)
    again, more = descend(spread, start, gradient, epochs=2, rate=0.1)
    assert (again["dense"] == got["dense"]).all() and more == losses
    other = Blocks.of(rows.repartition(9), steps=3, seed=5, block_rows=16)
    assert (descend(other, start, gradient, epochs=1, rate=0.1)[0]["dense"] == descend(blocks, start, gradient, epochs=1, rate=0.1)[0]["dense"]).all()


def test_many_equal_rows_are_spread_over_slices(spark):
    rows = spark.range(1000).select(F.array(F.lit(1.0)).alias("x"), F.lit(0).alias("label")).unionByName(spark.createDataFrame([([2.0], 1)], "x array<double>, label int"))
    blocks = Blocks.of(rows, steps=4)
    assert sorted(round(v) for v in blocks.weights.values()) == [250, 250, 250, 251]


def test_classifier_learns_calibrates_and_is_kept(spark, tmp_path):
    rows = toy(spark)
    train, held = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0").unionByName(spark.createDataFrame([(-1, [0.0, 0.0], None)], rows.schema))
    seen = []
    fitted = fit_classifier(train, held, classes=3, epochs=5, steps=2, rate=0.3, on_epoch=lambda e, m: seen.append((e, learning.accuracy_of(m, held.filter("label IS NOT NULL")))))
    assert [h[0] for h in fitted.history] == [1, 2, 3, 4, 5] and [h[2] for h in fitted.history] == pytest.approx([a for _, a in seen])
    assert fitted.history[-1][1] < fitted.history[0][1]
    best = evaluation.best_epoch(spark.createDataFrame([("m", e, a) for e, _, a in fitted.history], "group string, epoch int, accuracy double")).first()
    gold = held.filter("label IS NOT NULL").select(F.col("id"), F.col("label").cast("string").alias("label"))
    assert learning.accuracy_of(fitted.model, held.filter("label IS NOT NULL")) == pytest.approx(best["accuracy"])
    assert best["accuracy"] > evaluation.label_shares(gold).first()["majority"] + 0.1
    fitted.model.save(spark, str(tmp_path / "m"))
    loaded = Classifier.load(spark, str(tmp_path / "m"))
    assert (loaded.params["dense"] == fitted.model.params["dense"]).all() and loaded.temperature == fitted.model.temperature
    with pytest.raises(ValueError, match="not a encoder of format"):
        Encoder.load(spark, str(tmp_path / "m"))
    both = loaded.probabilities(rows.withColumn("terms", F.array().cast("array<int>"))).withColumn("sql", loaded.scores([F.col("x")[0], F.col("x")[1]])).withColumn("label_sql", loaded.label([F.col("x")[0], F.col("x")[1]])).collect()
    for r in both:
        assert r["probability"] == pytest.approx(r["sql"]) and sum(r["sql"]) == pytest.approx(1) and r["label_sql"] == int(np.argmax(r["probability"]))


def test_calibration_lowers_the_loss(spark):
    rows = toy(spark, noise=0.3).select("x", "label", F.array().cast("array<int>").alias("terms"))
    sure = Classifier({"dense": np.array([[9.0, 0, -18], [0, 0.18, 0.36], [0, 0, 0]])}, 0)
    loss = lambda m: m.probabilities(rows).agg(F.avg(-F.log(F.greatest(F.element_at("probability", F.col("label") + 1), F.lit(1e-300))))).first()[0]
    soft = learning.calibrated(sure, rows)
    assert soft.temperature > 1 and loss(soft) < loss(sure)
    assert learning.calibrated(sure, rows.limit(0)).temperature == 1.0


def test_without_rows_all_classes_are_alike(spark):
    none = spark.createDataFrame([], "x array<double>, label int")
    fitted = fit_classifier(none, none, classes=3)
    assert fitted.history == [] and fitted.model.classes == 3


def test_encoder_learns_pairs_it_has_not_seen(spark):
    rnd = random.Random(2)
    common = [f"c{i}" for i in range(20)]
    rows = [(str(i), " ".join(rnd.choices(common, k=30) + [f"t{i % 40}"]), " ".join(rnd.choices(common, k=30) + [f"t{i % 40}"])) for i in range(240)]
    pairs = spark.createDataFrame(rows + [("900", "", "a"), ("901", None, "b")], "pmid string, anchor string, positive string")
    start = Encoder.untrained(512, 32)
    train, held = pairs.filter("CAST(pmid AS INT) >= 40"), pairs.filter("CAST(pmid AS INT) < 40")
    told = []
    encoder, losses = start.train(train, epochs=4, steps=2, on_epoch=lambda e, _: told.append(e))
    assert told == [1, 2, 3, 4] and losses[-1] < losses[0]
    again, same = start.train(train, epochs=1, steps=2)
    assert same == losses[:1]

    def found(e):
        a, b = (np.array([r["vector"] for r in e.encode(held.select("pmid", F.col(c).alias("text"))).orderBy(F.col("pmid").cast("int")).collect()]) for c in ("anchor", "positive"))
        return (np.argsort(-(a @ b.T), axis=1)[:, :1] == np.arange(40)[:, None]).any(1).mean()

    assert found(encoder) > found(start)
    v = encoder.encode(spark.createDataFrame([("1", None), ("2", "")], "pmid string, text string")).collect()
    assert all(set(r["vector"]) == {0.0} for r in v)


def test_pairs_for_the_verifier_and_a_trained_report(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    docs = [(str(i), f"title {i}", " ".join(" ".join(word() for _ in range(8)) + "." for _ in range(5))) for i in range(60)]
    docs += [("copy1", "t", "Same words here now. Short one."), ("copy2", "t", "Same words here now. Short one."), ("one", "t", "Only one sentence here")]
    d = spark.createDataFrame(docs, "pmid string, title string, abstract string")
    pairs = learning.sentence_pairs(d, neighbours=1000)
    by = {}
    for r in pairs.collect():
        by.setdefault(r["pmid"], {})[r["label"]] = r["hypothesis"]
    assert "one" not in by and all(0 in p for p in by.values())
    texts = {p: a for p, _, a in docs}
    for p, rows in by.items():
        assert rows[0] in texts[p] and (1 not in rows or (rows[1] not in texts[p] and rows[2] not in texts[p]))
    held = F.pmod(F.xxhash64("pmid"), F.lit(4)) == 0
    fitted = learning.train_verifier(d, held_out=held, epochs=4, rate=0.3)
    assert max(a for *_, a in fitted.history) > 0.9
    said = spark.createDataFrame([("q1", f"{by['3'][0].rstrip('.')} [1].", ["3"]), ("q2", f"{by['3'][1].rstrip('.')} [1].", ["3"])], "query_id string, text string, passages array<string>")
    checked = verification.verdicts(said, d, lambda p, h: fitted.model.label(learning.pair_features(p, h)))
    assert {r["query_id"]: r["grounded"] for r in verification.report(said, checked).collect()} == {"q1": True, "q2": False}
    gate = learning.train_gate(d, held_out=held, epochs=4, rate=0.3).model
    asked = spark.createDataFrame([("in", by["3"][0]), ("off", "zz yy xx ww"), ("none", by["3"][0])], "query_id string, question string")
    hits = spark.createDataFrame([("in", "3", 1), ("off", "3", 1)], "query_id string, pmid string, rank int")
    p = {r["query_id"]: r["probability"] for r in verification.answerability(asked, hits, d, scorer=lambda c, q: F.get(gate.scores(learning.pair_features(c, q)), F.lit(1))).collect()}
    assert p["in"] > 0.5 > p["off"] and p["none"] < 0.5 and not math.isnan(p["none"])


def test_examples_have_the_features_of_their_pairs(spark):
    rnd = random.Random(3)
    docs = [(str(i), f"Title {i}", " ".join(" ".join(rnd.choices(["the", "of", "a", "heart", "lung", "b2", "é", "--"], k=rnd.randrange(1, 9))) + rnd.choice(".?!") for _ in range(rnd.randrange(1, 6)))) for i in range(80)]
    d = spark.createDataFrame([*docs, ("copy", "t", docs[0][2]), ("none", "!", "?. -- !"), ("empty", "", "")], "pmid string, title string, abstract string")
    held = F.pmod(F.xxhash64("pmid"), F.lit(4)) == 0
    got = learning.pair_examples(d, held_out=held)
    want = learning.sentence_pairs(d).select(held.alias("held"), F.array(*learning.pair_features(F.col("premise"), F.col("hypothesis"))).alias("x"), "label")
    rows = lambda df: sorted((r["held"], tuple(r["x"]), r["label"]) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 100
    pairs = lambda t: {" ".join(p) for p in zip(t, t[1:])}
    for t in ([], ["a"], ["a", "b"], ["a", "b", "a"], ["a", "b", "a", "b", "c"]):
        assert set(spark.range(1).select(learning._neighbours(F.lit(t).cast("array<string>") if t else F.array().cast("array<string>"))).first()[0]) == pairs(t)


def test_premises_are_cut_once_for_verifier_and_gate(spark, tmp_path, monkeypatch):
    from citeloom.functions import text as X
    from citeloom.plans import learned

    texts = [(i, f"Title {i}\nFirst w{i} one here. Then w{i} two and v{i} there! Short.", "en", "s", 10) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    cuts, own = [], X.terms
    monkeypatch.setattr(X, "terms", lambda c: cuts.append(str(c)) or own(c))
    assert len(learned._verifier(spark, str(tmp_path)).history) == len(learned._gate(spark, str(tmp_path)).history) == 4
    assert len([c for c in cuts if "premise" in c]) == 1


def test_best_epochs_of_models_that_share_their_pairs(spark, tmp_path, monkeypatch):
    from citeloom.plans import learned

    texts = [(i, f"Title {i}\nFirst w{i} one here. Then w{i} two and v{i} there! Short.", "en", "s", 10) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made, own = [], learning.pair_examples
    monkeypatch.setattr(learning, "pair_examples", lambda *a, **k: made.append(1) or own(*a, **k))
    best = {r["group"]: (r["epoch"], r["accuracy"]) for r in learned.best_epoch_trained(spark, str(tmp_path)).collect()}
    seen = {}
    for r in learned.training_epochs(spark, str(tmp_path)).collect():
        seen.setdefault(r["model"], []).append((r["accuracy"], -r["epoch"]))
    assert best == {m: (-e, a) for m, rows in seen.items() for a, e in [max(rows)]} and len(best) == 3 and len(made) == 1


def test_nothing_is_cut_twice_in_the_plan_of_the_examples(spark, monkeypatch):
    monkeypatch.setattr(learning, "settled", lambda df: df)
    docs = spark.createDataFrame([("1", "t", "One two. Three four.")], "pmid string, title string, abstract string")
    limit = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        plan = learning.pair_examples(docs, held_out=F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", limit)
    assert plan.count("regexp_extract_all(lower(premise") == plan.count("(?<=[.!?])") == 1 and "Filter" not in plan


def test_texts_of_classes_and_pairs_are_measured_once_and_without_a_string_for_each_letter(spark, tmp_path, monkeypatch):
    from citeloom.plans import learned

    texts = [(i, [None, "", "ÉT ß2 x\n\n Ab-c d İK", f"Title {i}\nFirst w{i}. Then v{i}!"][min(i, 3)], "en", "s", 10) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made, own = [], learning.text_features
    monkeypatch.setattr(learning, "text_features", lambda *a: made.append(1) or own(*a))
    assert learned._classes(spark, str(tmp_path)).history and learned.accuracy_trained(spark, str(tmp_path)).count() == 1 and len(made) == 1
    got = {r["doc_id"]: r["x"] for r in learned._judged(spark, str(tmp_path)).collect()}
    for i, text, *_ in texts[:6]:
        t = text or ""
        assert got[i] == pytest.approx([math.log1p(len(t)), math.log1p(len(t.split())), sum(c.isalpha() or c in " \n" for c in t) / len(t) if t else 0, math.log1p(t.count("\n"))])
    plan = spark.createDataFrame([("a",)], "t string").select(*learning.text_features(F.col("t"), 8))._jdf.queryExecution().optimizedPlan().toString()
    assert r"[\p{L}\s]" not in plan
    lines = []
    monkeypatch.setattr(learning, "_neighbours", lambda t: lines.append(t))
    learning.pair_examples(spark.createDataFrame([("1", "t", "One two. Three four.")], "pmid string, title string, abstract string"), held_out=F.lit(True))
    assert not lines


def test_an_index_of_what_is_asked_finds_what_the_whole_finds_and_verifying_builds_no_other(spark, tmp_path):
    from citeloom.operators import bm25
    from citeloom.operators.storage import built
    from citeloom.plans import learned, search
    from citeloom.sources.tables import documents, questions

    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 30))) + "\n" + " ".join(rnd.choices(words, k=12)) + ".", "en", "s", 10) for i in range(60)]
    texts += [(3, "w1 w2\nAgain w3.", "en", "s", 10), (90, "", "en", "s", 0), (91, "?!", "en", "s", 2), (92, None, "en", "s", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(i, " ".join(rnd.choices([*words, "nowhere"], k=4))) for i in range(8)] + [(20, ""), (21, None), (22, "w1 W1 w2")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs, q = documents(spark, d), questions(spark, d)
    alone = sorted(map(tuple, search._hits_alone(spark, d).collect()))
    reports = sorted(map(tuple, learned.verify_trained(spark, d).collect()))
    assert built(docs, "bm25") is None
    part, whole = bm25.Index.asked(docs, q), search._index(spark, d)
    assert built(docs, "bm25") is whole
    assert part.totals.collect() == whole.totals.collect() and alone == sorted(map(tuple, search._hits(spark, d).collect())) and alone
    wanted = {r["term"]: tuple(r) for r in whole.terms.collect() if r["term"] in " ".join(t or "" for _, t in asked).lower().split()}
    assert {r["term"]: tuple(r) for r in part.terms.collect()} == wanted
    assert sorted(map(tuple, learned.verify_trained(spark, d).collect())) == reports and len(reports) >= 8
    none = bm25.Index.asked(docs.limit(0), q)
    assert bm25.search(none, q).count() == 0
