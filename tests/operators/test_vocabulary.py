import json
import random

import pytest

from citeloom.operators import vocabulary
from citeloom.operators.vocabulary import applied, merges_of, ranked, render_sweep, sweep, with_token


def encode(word, merges):
    """Byte pair encoding by its definition: the pair of the least rank, leftmost first, until none is left."""
    symbols = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(merges.index(p), i) for i in range(len(symbols) - 1) if (p := (symbols[i], symbols[i + 1])) in merges]
        if not found:
            return symbols
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def random_merges(rnd, n):
    made, merges = [b"a", b"b", b"c", b" "], []
    while len(merges) < n:
        pair = rnd.choice(made), rnd.choice(made)
        if pair not in merges and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            made.append(pair[0] + pair[1])
    return merges


def test_one_replay_has_the_length_at_every_size():
    rnd = random.Random(1)
    for _ in range(60):
        merges = random_merges(rnd, 12)
        ranks = ranked(merges)
        for _ in range(10):
            word = bytes(rnd.choices(b"aabbc ", k=rnd.randint(0, 14)))
            steps = applied(word, ranks)
            assert steps == sorted(steps)
            for r in range(len(merges) + 1):
                assert len(word) - sum(s < r for s in steps) == len(encode(word, merges[:r]))
    assert len(applied(b"ab" * 100_000, ranked([(b"a", b"b"), (b"ab", b"ab")]))) == 150_000


def test_lists_that_do_not_nest_are_refused():
    with pytest.raises(ValueError):
        ranked([(b"ab", b"c"), (b"a", b"b")])


def test_sweep_equals_encoding_anew(spark):
    rnd = random.Random(3)
    merges = random_merges(rnd, 10)
    texts = [" ".join("".join(rnd.choices("abcé", k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + ["", None, "  \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [w for t in texts if t for w in t.split()]
    got = sweep(rows, merges, range(256, 267), prefix=b" ").orderBy("size").collect()
    assert [r["tokens"] for r in got] == [sum(len(encode(b" " + w.encode(), merges[: s - 256])) for w in words) for s in range(256, 267)]
    assert all(r["words"] == len(words) and r["fertility"] == r["tokens"] / len(words) for r in got)
    assert all(a["fertility"] >= b["fertility"] for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        sweep(rows, merges, [255])
    empty = sweep(rows.limit(0), merges, [256, 260]).collect()
    assert [(r["tokens"], r["words"], r["fertility"]) for r in empty] == [(0, 0, None)] * 2
    page = render_sweep({"one": sweep(rows, merges, [256, 266]), "none": sweep(rows.limit(0), merges, [256])})
    assert page.splitlines()[0] == "| vocabulary | one | none |" and page.splitlines()[-1].endswith("| - |") and len(page.splitlines()) == 4


def test_merges_of_a_file_against_the_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    merges = merges_of(spark, path)
    ranks, whole = ranked(merges), tokenizers.Tokenizer.from_file(path)
    for word in ("tokenization", "déjà", "日本語", "unbelievable", "a", "xyzzyqq"):
        assert len(b" " + word.encode()) - len(applied(b" " + word.encode(), ranks)) == len(whole.encode(" " + word, add_special_tokens=False).ids)
    (tmp_path / "t.json").write_text(json.dumps({"model": {"merges": ["a b", "ab Ġ"]}}))
    assert merges_of(spark, str(tmp_path / "t.json")) == [(b"a", b"b"), (b"ab", b" ")]
    assert vocabulary._alphabet()["Ġ"] == 32 and len(vocabulary._alphabet()) == 256


def test_added_token(spark):
    pieces = spark.createDataFrame([(0, "a"), (4, "b")], "id int, piece string")
    once = with_token(pieces, "[MASK]")
    assert sorted(map(tuple, once.collect())) == [(0, "a"), (4, "b"), (5, "[MASK]")] == sorted(map(tuple, with_token(once, "[MASK]").collect()))
    assert [tuple(r) for r in with_token(pieces.limit(0), "x").collect()] == [(0, "x")]
