import random
import re

import regex

from citeloom.llm.licenses import CHARS_PER_EDIT, NOTICES, fuzzy, scan, scan_licenses


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for i in range(len(words)):
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            if words[i : i + len(p)] == p:
                places.append((i, label))
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def edited(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(len(text))
        text = rnd.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "x" + text[i + 1 :]])
    return text


def test_seeds_lose_no_notice_within_its_edits():
    rnd = random.Random(8)
    for notice, label in NOTICES:
        k = len(notice) // CHARS_PER_EDIT
        for n in range(k + 1):
            for _ in range(5):
                plain = "some words here " + edited(rnd, notice, n) + " and more of them"
                if regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", plain):
                    assert any(f[0].label == label or f[3] <= n for f in fuzzy(plain)), (notice, n, plain)


def test_spans():
    text = "Ünder x.\nReleased under the\n MTI  License; y"
    _, matches = scan(text)
    (m,) = [m for m in matches if m.label == "mit"]
    assert text[m.start : m.end].startswith("Released") and "License" in text[m.start : m.end] and m.first_word == 2 and m.edits == 2 and 0.9 < m.score < 1


def test_clean_prose_has_none():
    assert scan("The license of the poet, who lives under the old version of a public house, in use for any purpose.") == ([], [])


def test_query_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["MIT", "mit", "License", "license", "general", "GENERAL", "public", "Apache", "été", "x\xa0y", "a-b", "42", "，"]
    rows = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, k=rnd.randrange(0, 40)))) for i in range(150)]
    rows += [(None, None), (3, ""), (3, ""), (900, "Licensed under CC BY-NC 4.0."), (901, "Licensd under the Apache Licence, Version 2.0"), (902, "word " * 30000 + "MIT License")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = scan_licenses(df, with_matches=True).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((d, *brute_base(t or "")) for d, t in rows), key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].labels == "cc-by-nc" and by_id[900].score == 1 and by_id[900].n_base == 0
    assert by_id[901].labels == "apache" and 0.9 < by_id[901].score < 1 and by_id[901].matches[0].edits == 2
    assert by_id[902].score == 1 and by_id[902].first_word == 30000
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert scan_licenses(df.limit(0)).collect() == []


def test_every_one_of_repeated_and_edited_notices_is_found():
    exact, near = "licensed under the apache license version 2 0", "licensd under the apache license version 2 0"
    assert [(f[0].text, f[1], f[3]) for f in fuzzy(f"{near} y {exact}")] == [(exact, 0, 1), (exact, len(near) + 3, 0)]
    plain = " and ".join([near, exact] * 40)
    finds = fuzzy(plain)
    assert [f[3] for f in finds] == [1, 0] * 40 and all(a[2] <= b[1] for a, b in zip(finds, finds[1:]))


def test_notices_of_one_family_are_told_apart():
    for notice, label in NOTICES:
        assert label in {f[0].label for f in fuzzy(f"x {notice} y")}, notice
    assert {f[0].label for f in fuzzy("licensed under cc by nd 4 0")} == {"cc-by-nd"}


def test_a_long_text_of_notices_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    assert len(scan("Released under the MIT License. " * 20_000)[1]) == 20_000
    assert time.perf_counter() - began < 30
