import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm.infilling import SLICE, Boundaries, fill_in_middle, original
from citeloom.llm.queries import op11_fill_in_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """The row by the rule's own words, over code points."""
    t = text or ""
    units = TOKEN.findall(t)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(t)


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 4096, SLICE - 1, SLICE, SLICE + 1, 2 * SLICE + 5])
def test_select_finds_what_the_rule_cuts(size):
    rnd = np.random.default_rng(size)
    data = rnd.choice(np.frombuffer(b" \t\nabcdefgh\xc3", np.uint8), size)
    ends = []
    for m in re.finditer(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", data.tobytes()):
        ends.append(m.end())
    found = Boundaries(data)
    assert len(found) == len(ends) and found.cut(0) == 0
    for k in {1, 2, len(ends) // 2, len(ends) - 1, len(ends)} & set(range(1, len(ends) + 1)):
        assert found.cut(k) == ends[k - 1]


TEXTS = ["", None, " ", "a", " a ", "\n\n", "été là-bas ça  va\t", "x<P>y and more", "one <S> two", "a<M>", "no marks < P> here <", "a b c d e", "日本語 と 英語 mixed\x85text wide", "\x00 nul", "w " * 5000 + "end", "<", "P> S> M>"]


def test_rows_against_the_rule(spark, tmp_path):
    rows = [(i * 37, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id here"), (5, "same id"), (5, "same id"), (-3, "minus one two")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("body", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_fill_in_middle(spark, str(tmp_path)).collect()]
    key = lambda r: (str(r[0]), r[5], r[6])
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_ways_back(spark):
    rows = [(i, f"w{i} and some <words \n here ção {i}") for i in range(60)]
    made = fill_in_middle(spark.createDataFrame(rows, "key long, body string"), id_col="key", text_col="body", rate=100, spm=50)
    got = made.withColumn("back", original(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"psm", "spm"}
    assert {r["doc_id"]: r["back"] for r in got} == dict(rows)
    assert all(r["output"].count("<P>") == r["output"].count("<S>") == r["output"].count("<M>") == 1 for r in got)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
