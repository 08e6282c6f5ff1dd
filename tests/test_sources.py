import gzip
import hashlib
import json
from itertools import chain

import pytest
from pyspark.sql import functions as F

from citeloom.sources import article_format, articles, manifest
from citeloom.sources.store import DocumentStore, KeyedStore
from citeloom.sources.tables import DOCUMENT
from tests.operators.test_corpus import XML, article


def test_article_format_reads_what_the_parser_does(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.xml").write_text(XML.format(article(1, "A <i>b</i> c", ("One.", "Two.")) + article(2) + "<PubmedArticle><MedlineCitation><PMID>9</PMID></MedlineCitation></PubmedArticle>" + article(3)))
    with gzip.open(folder / "a.xml.gz", "wt") as f:
        f.write(XML.format("".join(article(i) for i in range(10, 1300))))
    (folder / "c.txt").write_text("no")
    (tmp_path / "odd").write_text(XML.format(article(4)))
    article_format.register(spark)
    paths = [str(folder), str(tmp_path / "odd")]
    got = spark.read.format("articles").option("paths", json.dumps(paths)).load()
    cols = [c for c in got.columns if c not in ("path",)]
    plain = articles.raw_articles(spark, paths)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    rows = lambda df: sorted((repr(tuple(r)) for r in df.select(*cols, name).collect()))
    assert rows(got) == rows(plain) and got.count() == 1294
    assert articles.articles(got).count() == articles.articles(plain).count()
    found = spark.read.format("articles").load(str(folder)).filter("pmid IN ('3', '700')")
    assert sorted(r.pmid for r in found.collect()) == ["3", "700"]
    with pytest.raises(Exception, match="no article files"):
        (tmp_path / "none").mkdir()
        spark.read.format("articles").load(str(tmp_path / "none")).count()


def test_article_stream_goes_on_where_it_was(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    article_format.register(spark)

    def run():
        q = spark.readStream.format("articles").load(str(folder)).select("pmid").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.pmid for r in spark.read.schema("pmid string").parquet(str(tmp_path / "out")).collect())

    (folder / "n0001.xml").write_text(XML.format(article(1) + article(2)))
    assert run() == ["1", "2"]
    (folder / "n0002.xml").write_text(XML.format(article(3)))
    assert run() == ["1", "2", "3"] and run() == ["1", "2", "3"]


def test_long_files_stream_through(tmp_path):
    seen = 0
    body = XML.format("{}").split("{}")

    class Endless:
        """A file of 20,000 articles that is never whole anywhere."""

        def __init__(self):
            self.parts, self.held = chain([body[0]], (article(i) for i in range(20_000)), [body[1]]), b""

        def read(self, n):
            while len(self.held) < n:
                part = next(self.parts, None)
                if part is None:
                    break
                self.held += part.encode()
            out, self.held = self.held[:n], self.held[n:]
            return out

    import tracemalloc

    tracemalloc.start()
    for row in articles.read_articles(Endless()):
        seen += 1
    assert seen == 20_000 and tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def row(i, title, abstract="a"):
    return i, title, abstract, 2001, None, []


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_writes_are_as_large_as_what_they_write(spark, tmp_path):
    path = tmp_path / "docs"
    store = DocumentStore(spark, str(path), buckets=4, most_deltas=3)
    store.upsert(spark.createDataFrame([row(str(i), "old") for i in range(200)], DOCUMENT))
    first = files_of(path)
    store.upsert(spark.createDataFrame([row("5", "new"), row("5", "new"), row("x", "more"), row(None, "none")], "pmid string, title string, abstract string, year int, journal string, mesh_terms array<string>"))
    second = files_of(path)
    assert first < second and spark.read.parquet(*[str(path / f) for f in second - first]).count() == 2
    assert store.count() == 201 and [r.title for r in store.get(["5"]).collect()] == ["new"] and store.contains("x") and not store.contains("y")
    old = store.table(1)
    store.remove(spark.createDataFrame([("5",), ("gone",)], "pmid string"))
    assert store.count() == 200 and not store.contains("5") and old.count() == 200 and old.filter("pmid = '5'").first().title == "old"
    store.upsert(spark.createDataFrame([row("5", "again")], DOCUMENT))  # the third delta: touched buckets are written anew
    entry = store.snapshot()
    assert [p["kind"] for p in entry["parts"]] == ["base", "base"] and store.get(["5"]).first().title == "again" and store.count() == 201
    untouched = entry["parts"][0]["buckets"]
    assert untouched and not set(untouched) & set(entry["parts"][1]["buckets"])
    assert store.vacuum() > 0 and store.count() == 201 and [r.pmid for r in store.scan().limit(2).collect()] == ["0", "1"]


def test_dead_and_cut_off_writers_leave_the_snapshot(spark, tmp_path):
    path = tmp_path / "docs"
    store = DocumentStore(spark, str(path))
    store.add(spark.createDataFrame([row("1", "x")], DOCUMENT))
    store._write(spark.createDataFrame([row("2", "dead")], DOCUMENT).withColumn("_gone", F.lit(False)), 32)  # died before its commit
    log = sorted((path / "_log").glob("*.json"))
    (path / "_log" / f"{2:020d}.json").write_text(log[-1].read_text()[:20])  # died in its commit
    assert [r.pmid for r in DocumentStore(spark, str(path)).table().collect()] == ["1"]
    assert store.add(spark.createDataFrame([row("3", "y")], DOCUMENT)) == 2
    assert store.snapshot()["version"] == 3


def test_two_writers_both_count(spark, tmp_path):
    a, b = (DocumentStore(spark, str(tmp_path / "docs")) for _ in range(2))
    real = a._versions
    calls = []

    def late():
        seen = real()
        if not calls:
            calls.append(1)
            return seen
        if len(calls) == 1:
            calls.append(1)
            b.upsert(spark.createDataFrame([row("b", "by b")], DOCUMENT))  # takes the number that a was about to take
        return seen

    a._versions = late
    a.upsert(spark.createDataFrame([row("a", "by a")], DOCUMENT))
    assert sorted(r.pmid for r in b.table().collect()) == ["a", "b"]


def test_newest_seq_counts_and_batches_once(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "kv"), key="k")
    put = lambda rows, **o: store.upsert(spark.createDataFrame(rows, "k string, v string, seq int"), **o)
    assert put([("a", "1", 5), ("a", "0", 4), ("b", "1", 1)], done=("s", 0))
    assert put([("a", "late", 3), ("b", "2", 2)], done=("s", 1)) and not put([("a", "twice", 9)], done=("s", 1))
    assert {r.k: r.v for r in store.table().collect()} == {"a": "1", "b": "2"}
    store.remove(spark.createDataFrame([("a",)], "k string"))
    assert {r.k for r in store.table().collect()} == {"b"}
    store.compact()
    assert {r.k: r.v for r in store.table().collect()} == {"b": "2"}


def test_plain_parquet_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([row("1", "plain"), row("2", "plain")], DOCUMENT).write.parquet(path)
    store = DocumentStore(spark, path)
    assert store.count() == 2 and store.get(["2"]).count() == 1
    assert store.add(spark.createDataFrame([row("2", "new"), row("3", "new")], DOCUMENT)) == 3
    assert {r.pmid: r.title for r in store.table().collect()} == {"1": "plain", "2": "new", "3": "new"}


def test_folders_are_ingested_once_and_corrupt_files_refused(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    good = XML.format(article(1, "One") + article(2, "Two")).encode()
    (folder / "a.xml").write_bytes(good)
    (folder / "a.xml.md5").write_text(f"MD5(a.xml)= {hashlib.md5(good).hexdigest().upper()}\n")
    (folder / "b.xml").write_bytes(XML.format(article(3, "Three")).encode())
    (folder / "b.xml.md5").write_text("MD5(b.xml)= " + "0" * 32)
    store, seen = DocumentStore(spark, str(tmp_path / "store")), manifest.Manifest(spark, str(tmp_path / "files"))
    run = lambda: manifest.ingest_folder(spark, str(folder), store, seen, domain_filter=False)
    assert run() == {"files": 2, "pending": 2, "corrupt": 1, "parsed": 2, "stored": 2}
    assert {r.pmid for r in store.table().collect()} == {"1", "2"}
    assert {r.file.rsplit("/", 1)[1]: r.state for r in seen.table().collect()} == {"a.xml": "done", "b.xml": "corrupt"}
    again = run()
    assert again["pending"] == 1 and again["parsed"] == 0 and again["corrupt"] == 1
    (folder / "b.xml.md5").write_text("MD5(b.xml)= " + hashlib.md5((folder / "b.xml").read_bytes()).hexdigest())
    assert run()["parsed"] == 1 and store.count() == 3
    version = store.snapshot()["version"]
    real = articles.parsed
    monkeypatch.setattr(articles, "parsed", lambda files: pytest.fail("nothing is to be parsed"))
    assert run() == {"files": 2, "pending": 0, "corrupt": 0, "parsed": 0, "stored": 0} and store.snapshot()["version"] == version
    monkeypatch.setattr(articles, "parsed", real)
    (folder / "a.xml").write_bytes(XML.format(article(1, "One again, changed")).encode())
    (folder / "a.xml.md5").unlink()
    assert run()["pending"] == 1 and store.get(["1"]).first().title == "One again, changed"
    assert manifest.baseline_name(7) == "pubmed25n0007.xml.gz" and manifest.baseline_name(12, release="24", digits=3) == "pubmed24n012.xml.gz"


@pytest.mark.parametrize("name", ["store_merge", "store_upsert"])
def test_stores_give_the_rows_of_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    rows = [(1, "Große ﬁx\nx", "en", "s"), (2, "Maß", "de", "s"), (3, "plain", "fr", "s"), (4, "SS ß\ny", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
