import gzip
import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import answers, corpus, evaluation, training, verification
from citeloom.sources import articles, files

XML = """<PubmedArticleSet>
{}
</PubmedArticleSet>"""


def article(pmid, title="A title", abstract=("Some text.",), languages=("eng",), date="<Year>2001</Year>", mesh=("Heart",)):
    return f"""<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title>J</Title></Journal>
    <ArticleTitle>{title}</ArticleTitle><Abstract>{"".join(f"<AbstractText>{a}</AbstractText>" for a in abstract)}</Abstract>{"".join(f"<Language>{x}</Language>" for x in languages)}</Article>
    <MeshHeadingList>{"".join(f"<MeshHeading><DescriptorName>{m}</DescriptorName></MeshHeading>" for m in mesh)}</MeshHeadingList></MedlineCitation></PubmedArticle>"""


def test_articles(spark, tmp_path):
    rows = [article(1, "Effect of <i>x</i> on\n y", ("One <b>bold</b>.", " ", "Two.")), article(2, languages=("fre",)), article(3, title=" "), article(4, abstract=()), article(5, date="<MedlineDate>1998 Dec-1999 Jan</MedlineDate>", languages=()), article(6, title="Other", mesh=("Mice",))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(XML.format("\n".join(rows[:4])))
    with gzip.open(tmp_path / "in" / "b.xml.gz", "wt") as f:
        f.write(XML.format("\n".join(rows[4:] + [article(7, title="a TITLE.")])))
    (tmp_path / "in" / "note.txt").write_text("no")
    got = {r.pmid: r for r in articles.articles(articles.raw_articles(spark, [str(tmp_path / "in")])).collect()}
    assert set(got) == {"1", "5", "6", "7"}
    assert got["1"].title == "Effect of x on y" and got["1"].abstract == "One bold. Two." and got["1"].year == 2001 and got["5"].year == 1998 and got["1"].mesh_terms == ["Heart"]
    store = str(tmp_path / "store")
    assert articles.ingest(spark, [str(tmp_path / "in")], store) == {"parsed": 4, "unique": 3, "in_domain": 2, "stored": 2}
    assert articles.ingest(spark, [str(tmp_path / "in")], store, domain_filter=False)["stored"] == 3
    assert sorted(r.pmid for r in spark.read.parquet(store).collect()) == ["1", "5", "6"]


def greedy(rows):
    ids, prints, kept = set(), set(), []
    for seq, pmid, title in rows:
        if pmid not in ids and title not in prints:
            ids.add(pmid)
            prints.add(title)
            kept.append(seq)
    return kept


def test_greedy_dedup(spark):
    rnd = random.Random(5)
    cases = [[("1", "a"), ("2", "a"), ("2", "b"), ("1", "c"), ("3", "b")]] + [[(str(rnd.randrange(8)), rnd.choice("abcdefg")) for _ in range(25)] for _ in range(2)] + [[(str(i), rnd.choice("abc")) for i in range(20)]]
    for case in cases:
        rows = [(i, *r) for i, r in enumerate(case)]
        got = corpus.deduplicate(spark.createDataFrame(rows, "seq long, pmid string, title string"))
        assert sorted(r.seq for r in got.collect()) == greedy(rows)


def test_passages(spark):
    docs = spark.createDataFrame([("1", "aa bb ccc\ndd ee"), ("2", "xbb cccy"), ("3", "bb  ccc dd"), ("4", "")], "pmid string, text string")
    asked = spark.createDataFrame([("q1", "bb ccc\ndd"), ("q2", "bb ccc"), ("q3", "zz yy xx")], "query_id string, question string")
    assert sorted(map(tuple, corpus.passages_within(docs, asked).collect())) == [("q1", "1"), ("q2", "1"), ("q2", "2")]


def test_latency_picks_the_floor(spark):
    rows = [("a", 5.0), ("b", 1.0), ("b", 2.0), *[("c", float(i)) for i in (4, 1, 3, 2)]]
    got = {r.stage: (r["count"], r.p50, r.p95) for r in evaluation.latency(spark.createDataFrame(rows, "stage string, ms double")).collect()}
    assert got == {"a": (1, 5, 5), "b": (2, 2, 2), "c": (4, 3, 4)}


def test_risk_coverage_and_operating_point(spark):
    records = [(0, True, 0.9), (1, False, 0.5), (2, True, 0.5), (3, False, 0.1)]
    curve = answers.risk_coverage(spark.createDataFrame(records, "seq int, correct boolean, confidence double"))
    assert [(r.n, r.coverage, pytest.approx(r.error_rate)) for r in curve.orderBy("n").collect()] == [(1, 0.25, 0), (2, 0.5, 0.5), (3, 0.75, 1 / 3), (4, 1, 0.5)]
    assert answers.operating_point(curve, 0.6).first().n == 2
    for target in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            answers.operating_point(curve, target)


def test_measures_of_nothing_fail(spark):
    gold = spark.createDataFrame([("a", "yes"), ("b", "no")], "id string, label string")
    said = spark.createDataFrame([("a", "YES")], "id string, predicted string")
    assert tuple(evaluation.accuracy(said, gold).first()) == (0.5, 2)
    with pytest.raises(Exception, match="no gold labels"):
        evaluation.accuracy(said, gold.limit(0)).collect()
    hits = spark.createDataFrame([("q", "1", 1)], "query_id string, pmid string, rank int")
    assert evaluation.metrics(hits, hits.select("query_id", "pmid")).first().n_queries == 1
    with pytest.raises(Exception, match="no query has a relevant document"):
        evaluation.metrics(hits, hits.select("query_id", "pmid").limit(0)).collect()


def test_answers_and_verification(spark):
    docs = spark.createDataFrame([("1", "T", "Aspirin lowers fever. Nothing else."), ("2", "U", "Fever is high! Aspirin fever pain.")], "pmid string, title string, abstract string")
    asked = spark.createDataFrame([("q", "Does aspirin lower fever?"), ("off", "quantum")], "query_id string, question string")
    hits = spark.createDataFrame([("q", "1", 1, 3.0), ("q", "2", 2, 1.0)], "query_id string, pmid string, rank int, score double")
    found = answers.extract(asked, hits, docs)
    assert [(r.n, r.pmid, r.source, r.overlap) for r in found.orderBy("n").collect()] == [(1, "1", 1, 2), (2, "2", 2, 2), (3, "2", 2, 1)]
    assert [tuple(r) for r in answers.abstained(asked, found, hits).collect()] == [("off", [])]
    cited = answers.render(found).join(answers.sources(found), "query_id")
    assert cited.first().text == "Aspirin lowers fever [1]. Aspirin fever pain [2]. Fever is high [2]!"
    report = verification.report(cited, verification.verdicts(cited, docs)).first()
    assert (report.n, report.precision, report.recall, report.grounded) == (3, 1, 1, True)
    behind = answers.render(found, marker_after=True).join(answers.sources(found), "query_id")
    shifted = verification.report(behind, verification.verdicts(behind, docs)).first()
    assert shifted.n == 4 and shifted.recall == 0.75 and not shifted.grounded
    steps = verification.ladder(asked, cited, verification.report(cited, verification.verdicts(cited, docs)), cited).collect()
    assert {r.query_id: r.confidence for r in steps} == {"q": "grounded", "off": "abstain"}
    assert {r.query_id: (r.top_score, r.margin) for r in answers.confidence(asked, hits).collect()} == {"q": (3, 2), "off": (0, 0)}


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("q\tp\tn\nq\tp\tm\nbad\tline\n\tp\tn\nz\ty\tx\textra\n")
    found = files.triples(files.lines(spark, str(tmp_path / "t.tsv")))
    assert [tuple(r)[1:] for r in found.orderBy("seq").collect()] == [("q", "p", "n"), ("q", "p", "m"), ("z", "y", "x")]
    assert training.distinct_pairs(found).count() == 2 and files.triples(files.lines(spark, str(tmp_path / "t.tsv")), 2).count() == 2
    (tmp_path / "q.json").write_text('{"1": {"QUESTION": " q? ", "CONTEXTS": ["a", "b"], "final_decision": "yes"}, "2": {"QUESTION": "  ", "CONTEXTS": ["a"], "final_decision": "no"}, "3": {"QUESTION": "x", "CONTEXTS": [], "final_decision": "no"}}')
    assert [tuple(r) for r in files.qa_pairs(files.qa_entries(spark, str(tmp_path / "q.json"))).collect()] == [("1", "q?", "a b")]
    pairs = spark.createDataFrame([("a", "b"), ("a\tb", "c"), ("a", "c\rd")], "anchor string, positive string")
    assert files.write_pairs(pairs, str(tmp_path / "out")) == 1


def test_word_budget_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\n\n  three four five \nsix\nseven eight\n")
    rows = files.general_lines(files.lines(spark, str(tmp_path / "a.txt")))
    assert sorted(r.text for r in training.word_budget(rows, 5).collect()) == ["one two", "three four five"]
    mixed = training.mix(rows, rows, 0.75)
    assert sorted((r.part, r.text) for r in mixed.filter("part = 'general'").collect()) == [("general", "one two"), ("general", "three four five")]
    with pytest.raises(ValueError):
        training.mix(rows, rows, 0)
    (tmp_path / "p.tsv").write_text(" q one\t a b\tc \nno tab\n\tempty\nq2\tp2\n")
    assert sorted((r.anchor, r.positive) for r in files.pairs(files.lines(spark, str(tmp_path / "p.tsv"))).collect()) == [("q one", "a b\tc"), ("q2", "p2")]


def test_word_budget_and_negatives(spark):
    texts = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([3, 0, 4, 2, 9])], "seq long, text string")
    assert sorted(r.seq for r in training.word_budget(texts, 7).collect()) == [0, 1, 2]
    a = spark.createDataFrame([("q", "1", 1), ("q", "2", 2), ("q", "3", 3)], "query_id string, pmid string, rank int")
    b = spark.createDataFrame([("q", "4", 1), ("q", "2", 2)], "query_id string, pmid string, rank int")
    positives = spark.createDataFrame([("q", "1")], "query_id string, pmid string")
    assert [r.pmid for r in training.hard_negatives([a, b], positives, n=3).orderBy("place").collect()] == ["2", "3", "4"]


def test_trained_scorer(spark):
    rows = [("heart attack", "a heart attack study", 1), ("heart attack", "plants and water", 0), ("lung cancer", "lung cancer cells", 1), ("lung cancer", "heart and stone", 0)]
    df = spark.createDataFrame(rows, "query string, text string, label int")
    got = training.train_scorer(df).transform(training.pair_features(df)).select("label", "prediction").collect()
    assert all(r.label == r.prediction for r in got)


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "pmid string, title string, seq int")
    new = spark.createDataFrame([("2", "c", 1), ("3", "d", 1), ("3", "e", 2)], "pmid string, title string, seq int")
    assert {r.pmid: r.title for r in corpus.upsert(old, new).collect()} == {"1": "a", "2": "c", "3": "e"}
    assert corpus.split(spark.createDataFrame([("x",)], "query_id string"), "s").filter(F.col("part").isin("dev", "test")).count() == 1
