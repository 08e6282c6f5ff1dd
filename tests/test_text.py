import hashlib

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_cleaning_and_fingerprints(spark):
    assert one(spark, X.clean(F.col("a")), a="  x\xa0\n y\t") == "x y"
    assert one(spark, X.clean(F.col("a")), a=None) == ""
    assert one(spark, X.title_fingerprint(F.col("a")), a=" A  Study: of H2O! ") == "a study of h2o"
    assert one(spark, X.title_fingerprint(F.col("a")), a="日本") == ""


def test_capitals_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    assert one(spark, X.upper(F.col("a")), a="Straße ﬁx é") == "STRAẞE ﬁX É" and one(spark, X.upper(F.col("a")), a=None) is None
    letters = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    assert one(spark, X.upper(F.col("a")), a=letters) == duckdb.execute("SELECT upper(?)", [letters]).fetchone()[0]


def test_terms_and_sentences(spark):
    assert one(spark, X.terms(F.col("a")), a="The é-cat; 42 Cats") == ["the", "cat", "42", "cats"]
    assert one(spark, X.content_terms(F.col("a")), a="the cat and the Cat of 9") == ["cat", "9"]
    assert one(spark, X.sentences(F.col("a")), a="One. Two?  Three!\n v1.2 four . ") == ["One.", "Two?", "Three!", "v1.2 four ."]
    assert one(spark, X.word_count(F.col("a")), a=" a  b\nc ") == 3 and one(spark, X.word_count(F.col("a")), a="  ") == 0


def test_citations(spark):
    passages = F.array(F.lit("p1"), F.lit("p2"))
    for said, first, every in (("x [2] y [1].", "p2", [2, 1]), ("x [0].", None, []), ("x [3] [2] [2].", None, [2]), ("none", None, []), ("x [99999999999].", None, [])):
        assert one(spark, X.first_citation(F.col("a"), passages), a=said) == first
        assert one(spark, X.citations(F.col("a"), passages), a=said) == every


def test_years(spark):
    for own, free, want in (("2001", None, 2001), (" 1999 ", "2000 Jan", 1999), (None, "1998 Dec-1999 Jan", 1998), ("spring", None, None), ("²", "x", None), (None, None, None), ("20011", "2003", 20011)):
        assert one(spark, X.year(F.col("a"), F.col("b")), a=own, b=free) == want


def test_languages_and_domains(spark):
    assert one(spark, X.is_language(F.col("a")), a=[]) and one(spark, X.is_language(F.col("a")), a=["fre", "eng"]) and not one(spark, X.is_language(F.col("a")), a=["  "])
    assert one(spark, X.domains(F.col("a")), a=["Heart Neoplasms", "Mice"]) == ["cardiology", "oncology"]
    assert one(spark, X.domains(F.col("a")), a=[]) == []


def test_buckets_are_those_of_the_whole_digest(spark):
    for key in ("a", "12345", "é"):
        assert one(spark, X.hash_bucket("split", F.col("a")), a=key) == int(hashlib.sha256(f"split:{key}".encode()).hexdigest(), 16) % 100


def test_labels(spark):
    assert [one(spark, X.nli_label(F.col("a")), a=v) for v in ("Entailment", "neutral", "contrasting", "-", None)] == [0, 1, 2, None, None]
