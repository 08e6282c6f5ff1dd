import json

import pytest

from citeloom.cli import main
from citeloom.operators import answers, retrievers, serving, training, vectors
from citeloom.sources import files
from tests.operators.test_corpus import XML, article

ASKED = [("a", "Does aspirin lower fever?"), ("b", "quantum chess"), ("c", None)]
DOCS = [("1", "Aspirin", "Aspirin lowers fever. Cats sleep."), ("2", None, "Fever is heat!"), ("3", "Chess", "A game.")]
HITS = [("a", 1, "1", 2.5), ("a", 2, "2", 1.25), ("b", 1, "3", 0.5), ("b", 2, "9", 0.25)]


@pytest.fixture
def given(spark):
    asked = spark.createDataFrame(ASKED, "query_id string, question string")
    docs = spark.createDataFrame(DOCS, "pmid string, title string, abstract string")
    hits = spark.createDataFrame(HITS, "query_id string, rank int, pmid string, score double")
    return asked, docs, hits


def payloads(asked, found, hits, docs):
    return {r["query_id"]: (r["abstained"], json.loads(r["json"])) for r in serving.answer_payloads(asked, found, hits, docs).collect()}


def test_answer_payloads(given):
    asked, docs, hits = given
    got = payloads(asked, answers.extract(asked, hits, docs), hits, docs)
    assert got["a"] == (
        False,
        {
            "query": "Does aspirin lower fever?",
            "abstained": False,
            "confidence": "GROUNDED",
            "sentences": [{"text": "Aspirin lowers fever.", "pmid": "1", "citation": 1}, {"text": "Fever is heat!", "pmid": "2", "citation": 2}],
            "sources": [{"citation": 1, "pmid": "1", "title": "Aspirin"}, {"citation": 2, "pmid": "2", "title": None}],
            "disclaimer": serving.DISCLAIMER,
        },
    )
    # A document that isn't there has no title; a question without hits has nothing near.
    assert got["b"][0] and got["b"][1]["nearest"] == [{"pmid": "3", "title": "Chess"}, {"pmid": "9", "title": None}] and "sentences" not in got["b"][1]
    assert got["c"] == (True, {"query": None, "abstained": True, "confidence": "ABSTAIN", "nearest": [], "disclaimer": serving.DISCLAIMER})
    assert serving.shown(got["a"][1]) == f"GROUNDED\nAspirin lowers fever [1]. Fever is heat [2]!\n[1] 1 Aspirin\n[2] 2\n{serving.DISCLAIMER}"
    assert serving.shown(got["b"][1]) == "ABSTAIN\nnearest: 3 Chess\nnearest: 9"


def test_written_answers_keep_their_numbers(spark, given):
    asked, docs, hits = given
    made = spark.createDataFrame([("a", "Fever is heat [2]. Aspirin lowers fever [1]. It is said [7].", ["1", "2"])], "query_id string, text string, passages array<string>")
    _, got = payloads(asked, serving.cited(made), hits, docs)["a"]
    assert [(s["text"], s["pmid"], s["citation"]) for s in got["sentences"]] == [("Fever is heat.", "2", 2), ("Aspirin lowers fever.", "1", 1), ("It is said.", None, 7)]
    assert [s["citation"] for s in got["sources"]] == [1, 2]


def test_passages_and_events(given):
    asked, docs, hits = given
    got = {r["query_id"]: json.loads(r["json"]) for r in serving.passage_payloads(asked, hits, docs, k=1).collect()}
    assert got["a"] == {"query": "Does aspirin lower fever?", "passages": [{"pmid": "1", "score": 2.5, "title": "Aspirin"}]} and got["c"] == {"query": None, "passages": []}
    sent = serving.answer_payloads(asked, answers.extract(asked, hits, docs), hits, docs)
    rows = sorted(tuple(r) for r in serving.events(asked, hits, sent).collect())
    assert [(r[0], r[2]) for r in rows] == [(q, e) for q in "abc" for e in ("retrieval", "answer", "done")]
    assert json.loads(rows[0][3]) == [{"pmid": "1", "score": 2.5}, {"pmid": "2", "score": 1.25}] and rows[6][3] == "[]" and rows[8][3] == "{}"
    text = serving.events(asked, hits, sent).filter("place = 2").select(serving.server_sent(*[serving.F.col(c) for c in ("event", "data")])).first()[0]
    assert text == "event: done\ndata: {}\n\n"


def test_service_metrics(spark):
    requests = spark.createDataFrame([("ask",), ("ask",), ("health",)], "endpoint string")
    samples = spark.createDataFrame([("answer", float(i)) for i in range(1, 11)], "stage string, ms double")
    got = json.loads(serving.service_metrics(requests, samples).first()[0])
    assert got == {"counters": {"ask": 2, "health": 1}, "latency_ms": {"answer": {"p50": 6.0, "p95": 10.0, "count": 10}}}
    empty = json.loads(serving.service_metrics(requests.limit(0), samples.limit(0)).first()[0])
    assert empty == {"counters": {}, "latency_ms": {}}


def test_texts_for_pretraining_and_arrays_of_negatives(spark):
    one = spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("",)], "text string")
    two = spark.createDataFrame([("y", 1), ("z", 2)], "text string, other int")
    assert sorted(r[0] for r in training.distinct_texts(one, two).collect()) == ["x", "y", "z"]
    triples = spark.createDataFrame([("q", "p", ["n", "m"]), ("r", "s", [])], "query string, positive string, negative array<string>")
    assert sorted(tuple(r) for r in training.labelled_pairs(triples).collect()) == [("q", "m", 0), ("q", "n", 0), ("q", "p", 1), ("r", "s", 1)]


def test_probes_give_recall_and_latency(spark, tmp_path):
    points = vectors.embed(spark.createDataFrame([(str(i), f"word{i % 40} term{i % 7} other{i}") for i in range(400)], "pmid string, text string"), 16)
    asked = points.filter("cast(pmid AS int) % 40 = 0").withColumnRenamed("pmid", "query_id")
    rows = sorted(retrievers.ann_curve("ivf", points, asked, [1, 400], path=str(tmp_path / "i")).collect())
    assert [r["probes"] for r in rows] == [1, 400] and rows[0]["recall"] <= rows[1]["recall"] == 1 and all(r["ms"] > 0 for r in rows)


def test_runs_are_kept(spark, tmp_path):
    path = str(tmp_path / "runs")
    files.track(spark, path, "first", {"mrr": 0.5, "n": 3}, {"k1": 1.2})
    files.track(spark, path, "second", {"mrr": 0.75})
    got = {(r["run"], r["metric"]): (r["value"], r["params"]) for r in spark.read.parquet(path).collect()}
    assert got == {("first", "mrr"): (0.5, {"k1": "1.2"}), ("first", "n"): (3.0, {"k1": "1.2"}), ("second", "mrr"): (0.75, {})}


def test_commands_answer_train_and_study(spark, tmp_path, capsys):
    text = "Aspirin lowers fever in adults and children. It works within an hour of the dose."
    articles = [article(10, "Aspirin and fever", (text,)), *[article(20 + i, f"Stone {i}", (f"Granite number{i} is hard and cold everywhere. Quarries sell block{i} to masons and builders.",)) for i in range(12)]]
    (tmp_path / "a.xml").write_text(XML.format("".join(articles)))
    store = str(tmp_path / "store")
    assert main(["ingest", str(tmp_path / "a.xml"), "--store", store, "--no-domain-filter"], spark) == 0
    for model in ("encoder", "verifier"):
        capsys.readouterr()
        assert main(["train", model, "--store", store, "--out", str(tmp_path / model), "--epochs", "2"], spark) == 0
        assert [json.loads(line)["epoch"] for line in capsys.readouterr().out.splitlines()] == [1, 2]
    ask = ["ask", "Does aspirin lower fever?", "--store", store, "--index", str(tmp_path / "index")]
    assert main([*ask, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["sources"][0] == {"citation": 1, "pmid": "10", "title": "Aspirin and fever"}
    assert main([*ask, "--stream"], spark) == 0
    assert [line for line in capsys.readouterr().out.splitlines() if line.startswith("event")] == ["event: retrieval", "event: answer", "event: done"]
    for extra in (["--answerer", "generated"], ["--answerer", "generated", "--verifier", str(tmp_path / "verifier")], ["--retriever", "dense", "--embedder", str(tmp_path / "encoder")]):
        assert main([*ask, *extra], spark) == 0
        assert capsys.readouterr().out.startswith("GROUNDED\nAspirin lowers fever in adults and children [")
    assert main([*ask, "--retriever", "dense", "--embedder", str(tmp_path / "none")], spark) == 1
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"query_id": i, "question": q}) + "\n" for i, q in (("1", "aspirin fever"), ("2", "quantum chess"))))
    capsys.readouterr()
    assert main(["answer", str(tmp_path / "q.jsonl"), "--store", store, "--out", str(tmp_path / "answers")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"questions": 2, "abstained": 1}
    assert {r["query_id"]: r["abstained"] for r in spark.read.parquet(str(tmp_path / "answers")).collect()} == {"1": False, "2": True}
    (tmp_path / "s.json").write_text(json.dumps({"name": "s", "queries": [{"query_id": "1", "question": "number7 granite", "relevant_pmids": ["27"]}]}))
    capsys.readouterr()
    assert main(["evaluate", str(tmp_path / "s.json"), "--store", store, "--track", str(tmp_path / "runs"), "--run", "x"], spark) == 0
    assert {r["run"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"x"}
    capsys.readouterr()
    assert main(["study", "ann", str(tmp_path / "s.json"), "--store", store, "--ann", "ivf", "--probes", "1", "4"], spark) == 0
    assert [json.loads(line)["probes"] for line in capsys.readouterr().out.splitlines()] == [1, 4]
    assert main(["study", "calibration", str(tmp_path / "s.json"), "--store", store, "--target", "0.9"], spark) == 0
    assert json.loads(capsys.readouterr().out)["coverage"] == 1
