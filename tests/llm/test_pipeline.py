import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from citeloom.llm.secrets import redact
from citeloom.llm.toxicity import score_toxicity


def similar(a, b):
    sets = [set(zip(*(t.lower().split()[j:] for j in range(5)))) for t in (a, b)]
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) if all(sets) else a.lower().split() == b.lower().split()


def test_stages_over_the_smallest_tables(spark):
    """Each stage against a plain version of it over its own input, and run() against them in a row."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows.get("last") or docs.collect()
        out = stage(spark, spark.createDataFrame(before, docs.schema), sf)
        if name == "best_fit_packing":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sizes = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
            got = out.collect()
            for d, n in sizes.items():
                assert sum(r.length for r in got if r.doc_id == d) == n
            packed = {(r.doc_id, r.piece, r.ids_crc32) for r in got}
            continue
        assert out.columns == columns
        after = out.collect()
        kept = {r.doc_id for r in after}
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                best[key] = max(best.get(key, -1), r.doc_id)
            assert kept == set(best.values())
        elif name == "near_dedup":
            group = {r.doc_id: r.doc_id for r in before}
            for a in before:
                for b in before:
                    if a.doc_id < b.doc_id and similar(a.text or "", b.text or ""):
                        x, y = sorted((group[a.doc_id], group[b.doc_id]))
                        group = {k: x if v == y else v for k, v in group.items()}
            assert kept == set(group.values())
        elif name == "secret_scan":
            assert {(r.doc_id, r.text, r.n_chars) for r in after} == {(r.doc_id, redact(r.text), len(redact(r.text))) for r in before}
        else:
            assert 0.5 * len(before) < len(kept) <= len(before)
            scored = score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert kept == {r.doc_id for r in scored if not r.predicted}
        rows["last"] = after
    run = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in run.collect()} == packed


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, a long text and columns of clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    words = " ".join(f"x{i}" for i in range(50))
    rows = [(1, words, "s", 1, 1), (1, words, "s", 2, 2), (2, words + " more", "s", 3, 3), (3, None, "s", 4, 4), (4, "", "s", 5, 5), (None, "no id here", "s", 6, 6), (None, "no id here", "s", 7, 7), (5, "secret=abcdefgh12 and so on", None, 8, 8), (6, long, "s", 9, 9), (7, "y", "s", 10, 10), (7, "z", "s", 11, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, root int").withColumnRenamed("root", "id")
    df = df.selectExpr("doc_id", "text", "source AS th", "n_chars", "id", "'k' AS ck", "0 AS normal_text", "'q' AS label")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = df, df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = sorted(((r.doc_id or 0, (r.text or "")[:8]) for r in docs.collect()))
    assert left == [(0, "no id he"), (1, words[:8]), (4, ""), (5, "secret=["), (6, long[:8]), (7, "y"), (7, "z")]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, 1, 4, 5, 6, 7} and sum(r.length for r in packed if r.doc_id == 4) == 1
    assert sum(r.doc_id == 6 for r in packed) > 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
