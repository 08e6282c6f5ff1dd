import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm import bpe, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "a", "it's we'll  I'd\n\n  x", "a\xa0 b", "a\x85\n b", "x　 y \n", "<|endoftext|>", "a <|endoftext|>  b|<|endoftext|>c", "é́ ñ9a8", "Straße.Über,Ölé\t\tq", "日本語 text。 ", "\x1c a\x1fb", "a'S 've", "  lead", "trail  ", "😀 😀\n", "αβγ.Δ", "ab'c'd", "\r\n \r\n"]


def whole(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text, add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x85\xa0 .,'|<>abstréßД日́₂1\x1c"), st.characters(codec="utf-8")), max_size=30))
def test_pieces_encode_like_the_whole_text(text):
    pieces = bpe.split_pieces(text.encode())
    assert "".join(pieces) == text
    t = bpe.tokenizer(PATH)
    assert [i for p in pieces for i in t.encode(p, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_round_trip_against_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, None), (3, "the cat " * 5000), (3, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).sortWithinPartitions("text")
    df = spark.createDataFrame(df.collect(), "doc_id long, text string")
    got = bpe.encode_decode(df, PATH, with_ids=True).collect()
    want = []
    for d, t in rows:
        ids, back = whole(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert back == (t or "")
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert {r.decoded for r in got} == {t or "" for _, t in rows}


def test_words_of_every_chunk_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20)
    monkeypatch.setattr(bpe, "block_of", lambda chunk: words.block_of(chunk, 2, 2))
    rows = [(i, f"the cat's {i % 7} жизнь the") for i in range(60)]
    got = {r.doc_id: (r.n_tokens, r.decoded) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, with_ids=True).collect()}
    assert got == {d: (len(whole(t)[0]), t) for d, t in rows}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, chunk string, idx int")
    assert bpe.encode_decode(df, PATH).collect() == []
    df = spark.createDataFrame([(1, "a b", "x", 1)], "doc_id long, text string, chunk string, idx int")
    assert bpe.encode_decode(df, PATH).first().n_tokens == 2


def test_packing_positions():
    x = np.arange(70000, dtype=np.uint32)[::-1].copy()
    assert (words.unpack(words.pack(x), len(x)) == x).all()
    assert len(words.unpack(words.pack(x[:0]), 0)) == 0


def test_a_text_of_several_megabytes(spark):
    text = "The cat's sat, жизнь and été.\n" * 100_000
    (row,) = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    ids, back = whole(text)
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_characters_cut_by_the_ends_of_slices():
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    table = {3: "😀".encode()[:1], 5: "😀".encode()[1:], 9: b"a"}
    texts = [[3, 5, 9], [], [9, 3, 5, 3], [5, 9]]
    flat = np.array([i for t in texts for i in t], "<u4")
    for size in (1, 2, 3, 20):
        parts = [len(p).to_bytes(4, "little") + words.pack(p) for p in (flat[i : i + size] for i in range(0, len(flat), size))]
        n = max(len(parts), len(table))
        rows = pa.table({"id": pa.array([*table, *[None] * (n - len(table))], pa.int32()), "part": pa.array(parts + [None] * (n - len(parts)), pa.binary()), "piece": pa.array([*table.values(), *[None] * (n - len(table))], pa.binary())})
        got = [r for b in bpe.decoded({"doc_id": [0, 1, 2, 3], "n_ids": [len(t) for t in texts]}, rows, types) for r in b.to_pylist()]
        for r, t in zip(got, texts, strict=True):
            body = b"".join(table[i] for i in t).decode("utf-8", "replace")
            assert (r["ids"], r["decoded"], r["n_tokens"]) == (t, body, len(t))
            assert r["decoded_sha256"] == hashlib.sha256(body.encode()).hexdigest() and r["ids_sha256"] == hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest()
