import json

import pytest

from citeloom.cli import main
from citeloom.operators import bm25, evaluation, retrievers
from citeloom.sources.store import DocumentStore
from citeloom.sources.tables import DOCUMENT
from citeloom.streaming.ingest import read_store, stream_upserts, windowed_latency
from tests.operators.test_corpus import XML, article


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.xml").write_text(XML.format(article(10, "Aspirin and fever", ("Aspirin lowers fever. It works.",)) + article(11, "Stones", ("Granite is hard.",), mesh=("Cancer",))))
    store = str(tmp_path / "store")
    assert main(["ask", "x", "--store", store], spark) == 1
    assert main(["ingest", str(tmp_path / "none.xml"), "--store", store], spark) == 1
    assert main(["ingest", str(tmp_path / "a.xml"), "--store", store], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"parsed": 2, "unique": 2, "in_domain": 2, "stored": 2}
    for kind in ("bm25", "hybrid"):
        assert main(["ask", "Does aspirin lower fever?", "--store", store, "--retriever", kind], spark) == 0
        out = capsys.readouterr().out
        assert out.startswith("GROUNDED\nAspirin lowers fever [1].") and "[1] 10" in out
    assert main(["ask", "quantum chess", "--store", store], spark) == 0 and capsys.readouterr().out == "ABSTAIN\n"
    (tmp_path / "s.json").write_text(json.dumps({"name": "s", "queries": [{"query_id": "1", "question": "granite", "relevant_pmids": ["11"]}]}))
    assert main(["evaluate", str(tmp_path / "s.json"), "--store", store], spark) == 0
    assert json.loads(capsys.readouterr().out)["mrr"] == 1
    assert main(["report", "--store", store], spark) == 0
    out = capsys.readouterr().out
    assert "| 2001 | 2 |" in out and "| out_of_scope |" in out and "| journal | documents |" in out


def test_saved_indexes_checksums_and_metrics(spark, tmp_path, capsys):
    (tmp_path / "odd.name").write_text(XML.format("".join(article(i, f"Title {i}", (f"Granite number{i} is hard.",)) for i in range(12))))
    store, index = str(tmp_path / "store"), str(tmp_path / "index")
    (tmp_path / "empty").mkdir()
    assert main(["ingest", str(tmp_path / "empty"), "--store", store], spark) == 1
    assert main(["ingest", str(tmp_path / "odd.name"), "--store", store, "--no-domain-filter"], spark) == 0
    (tmp_path / "s.json").write_text(json.dumps({"name": "s", "queries": [{"query_id": "1", "question": "number7 granite", "relevant_pmids": ["7"]}]}))
    sums = tmp_path / "sums.json"
    sums.write_text(json.dumps({"s.json": "0" * 64}))
    args = ["evaluate", str(tmp_path / "s.json"), "--store", store, "--index", index, "--checksums", str(sums), "--out", str(tmp_path / "m.json")]
    assert main(args, spark) == 1
    said = capsys.readouterr()
    sums.write_text(json.dumps({"s.json": said.err.strip().rsplit(" ", 1)[1]}))
    for extra in ([], ["--rerank"], ["--retriever", "hybrid", "--ann", "ivf"], ["--retriever", "dense", "--ann", "hnsw"]):
        assert main([*args, *extra], spark) == 0
        assert json.loads(capsys.readouterr().out)["mrr"] == json.loads((tmp_path / "m.json").read_text())["mrr"] == 1
    kept = {p.name.split("-")[0]: p for p in (tmp_path / "index").iterdir()}
    assert set(kept) == {"bm25", "ivf", "hnsw"} and (kept["bm25"] / "terms").exists() and (kept["ivf"] / "centroids").exists()
    spark.range(1).selectExpr("99 AS version").write.mode("overwrite").parquet(f"{kept['bm25']}/format")
    with pytest.raises(ValueError, match="format 99"):
        bm25.Index.load(spark, str(kept["bm25"]))
    with pytest.raises(ValueError, match="unknown retriever"):
        retrievers.build("sparse", spark.read.parquet(store))


def test_kept_indexes_follow_the_store(spark, tmp_path):
    store, index = DocumentStore(spark, str(tmp_path / "docs")), str(tmp_path / "index")
    row = lambda i, title: (i, title, f"text of {i}", 2001, None, [])
    asked = spark.createDataFrame([("q", "granite")], "query_id string, question string")
    store.add(spark.createDataFrame([row("3", "granite"), row("4", "chalk")], DOCUMENT))
    found = lambda kind, **o: {r["pmid"] for r in retrievers.build(kind, store.table(), index=index, **o).search(asked, 5).collect()}
    assert found("bm25") == {"3"} and found("dense", ann="ivf", probes=9) == {"3", "4"}
    store.add(spark.createDataFrame([row("7", "granite again")], DOCUMENT))
    assert found("bm25") == {"3", "7"} and found("dense", ann="ivf", probes=9) == {"3", "4", "7"} and found("dense", ann="hnsw") == {"3", "4", "7"}
    before = sorted(p.name for p in (tmp_path / "index").iterdir())
    assert found("bm25") == {"3", "7"} and sorted(p.name for p in (tmp_path / "index").iterdir()) == before  # read back, not made again
    from citeloom.operators.vectors import embed

    found("dense", ann="ivf", encode=lambda t: embed(t, 16))
    assert len(list((tmp_path / "index").iterdir())) == len(before) + 1


def test_document_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    row = lambda i, title: (i, title, "a", 2001, None, [])
    assert store.count() == 0 and not store.contains("1")
    assert store.add(spark.createDataFrame([row("1", "x"), row("2", "y")], DOCUMENT)) == 2
    for _ in range(2):
        assert store.add(spark.createDataFrame([row("2", "z"), row("0", "w")], DOCUMENT)) == 3
    assert [(r.pmid, r.title) for r in store.scan().collect()] == [("0", "w"), ("1", "x"), ("2", "z")]
    assert store.contains("2") and [r.title for r in store.get(["2", "9"]).collect()] == ["z"]


def test_stage_timer(spark):
    timer = evaluation.StageTimer()
    for _ in range(3):
        with timer.stage("a"):
            pass
    (row,) = evaluation.latency(timer.table(spark)).collect()
    assert row["stage"] == "a" and row["count"] == 3 and row["p50"] >= 0


def test_stream_upserts_and_windows(spark, tmp_path):
    schema = "pmid string, title string, seq int"
    spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    for rows in ([], [("2", "c", 2), ("3", "d", 2)]):
        if rows:
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"), mode="append")
        q = stream_upserts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {r.pmid: r.title for r in read_store(spark, str(tmp_path / "store")).collect()} == {"1": "a", "2": "c", "3": "d"}
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:04:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 00:06:00', 'a', 5.0D")
    assert sorted((r.n, r["mean"]) for r in windowed_latency(events).collect()) == [(1, 5.0), (2, 2.0)]
