import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import answers, bm25, generation, verification
from citeloom.operators.generation import ABSTAIN, CITE, SILENCE, STOP, WORD, Grammar, State, decode


def test_grammar():
    g = Grammar(2, sentences=2, least=2, most=3)
    s = State()
    assert g.allowed(s) == {WORD, SILENCE} and Grammar(0).allowed(s) == {SILENCE}
    s = g.step(g.step(s, WORD), WORD)
    assert g.allowed(s) == {WORD, CITE} and g.allowed(g.step(s, WORD)) == {CITE}
    for number in (0, 3):
        with pytest.raises(ValueError):
            g.step(s, CITE, number)
    s = g.step(s, CITE, 2)
    assert g.allowed(s) == {WORD, STOP} and g.allowed(g.step(s, STOP)) == set()
    with pytest.raises(ValueError):
        g.step(State(0, 1), CITE, 1)
    full = g.step(g.step(g.step(s, WORD), WORD), CITE, 1)
    assert g.allowed(full) == {STOP}


def test_decoded_texts_are_of_the_grammar_and_the_passages():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    for _ in range(40):
        passages = [[" ".join(rnd.choices(words, k=rnd.randint(1, 12))) + rnd.choice([".", "", "?"]) for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(0, 4))]
        question = " ".join(rnd.choices(words, k=4))
        text = decode(question, passages, sentences=2, most=9)
        assert text == decode(question, passages, sentences=2, most=9)
        if text == ABSTAIN:
            continue
        sentences = generation.re.findall(r"(.*?) \[(\d+)\][.?]\s*", text)
        assert 1 <= len(sentences) <= 2 and len({s for s, _ in sentences}) == len(sentences)
        steps = {(a, b) for p in passages for s in p for a, b in zip(s.split(), s.split()[1:])}
        for s, n in sentences:
            assert 1 <= int(n) <= len(passages) and 3 <= len(s.split()) <= 9
            assert all((a, b) in steps or any((a, b + end) in steps for end in ".?") for a, b in zip(s.split(), s.split()[1:]))
            assert generation.content(s) & generation.content(question)


def test_silence_without_grounds():
    assert decode("granite", []) == ABSTAIN and decode("granite", [[]]) == ABSTAIN
    assert decode("granite", [["Chalk is soft here."]]) == ABSTAIN and decode("", [["Chalk is soft here."]]) == ABSTAIN
    assert decode("what is the granite", [["Chalk is soft."], ["Old granite is hard!", "Sand is not."]]) == "Old granite is hard [2]!"


def test_three_rungs(spark):
    docs = spark.createDataFrame([("1", "Stone", "Granite is a hard stone. It lies deep."), ("2", "Chalk", "Chalk is a soft stone of shells."), ("3", "Fog", "Fog hides.")], "pmid string, title string, abstract string")
    asked = spark.createDataFrame([("g", "How hard is granite?"), ("e", "fog"), ("n", "quantum chess"), ("z", None)], "query_id string, question string")
    index = bm25.Index.build(docs)
    hits = bm25.search(index, asked, 5)
    made = generation.generate(asked, hits, docs)
    rows = {r["query_id"]: r for r in made.withColumn("ok", generation.well_formed(F.col("text"), F.col("passages"))).collect()}
    assert all(r["ok"] for r in rows.values()) and len(rows) == 4
    assert rows["g"]["text"].startswith("Granite is a hard stone [1].") and rows["n"]["text"] == rows["z"]["text"] == rows["e"]["text"] == ABSTAIN  # fog has two words, a sentence three
    said = generation.spoken(made)
    reports = verification.report(said, verification.verdicts(said, docs))
    found = verification.ladder(asked, said, reports, answers.render(answers.extract(asked, hits, docs)))
    assert {r["query_id"]: r["confidence"] for r in found.collect()} == {"g": "grounded", "e": "extractive", "n": "abstain", "z": "abstain"}
    bad = spark.createDataFrame([("Hard [3].", ["1"]), ("Hard.", ["1"]), ("Hard [0]. Soft [1].", ["1"]), ("", ["1"]), ("Hard [1].", ["1"])], "text string, passages array<string>")
    assert [r[0] for r in bad.select(generation.well_formed(F.col("text"), F.col("passages"))).collect()] == [False, False, False, False, True]
