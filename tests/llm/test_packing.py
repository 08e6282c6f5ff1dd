import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm.packing import WordIds, _best_pair, best_two_fit, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x85\xa0 .,'|<>abEÉsΣßДI1\x1c\x0c"), st.characters(codec="utf-8")), max_size=30))
def test_words_encode_like_the_whole_text(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(WordIds(PATH).texts([text.encode()])), "<u4").tolist() == want


def test_marks_and_special_tokens():
    t = Tokenizer.from_file(PATH)
    ids = WordIds(PATH)
    texts = ["Word. word, (it's) x). a.. b| é. É, 9. I'll! <|endoftext|> <|ENDOFTEXT|>. x<|startoftext|>", "<|endoftext|>|", "a|<|endoftext|>.", "A word. THE word."]
    for got, text in zip(ids.texts([x.encode() for x in texts]), texts):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_pairs_against_all_pairs():
    rnd = random.Random(2)
    for _ in range(300):
        have = np.array([0] + [rnd.choice([0, 0, 1, 2]) for _ in range(30)])
        room = rnd.randrange(1, 50)
        best = max((a + b for a in range(1, 31) for b in range(1, a + 1) if have[a] and have[b] and (a != b or have[a] > 1) and a + b <= room), default=None)
        got = _best_pair(have, room)
        assert (sum(got) if got else None) == best


def test_plan_packs_everything_tightly():
    rnd = random.Random(4)
    counts = Counter(rnd.randrange(1, 101) for _ in range(5000))
    plan = best_two_fit(counts, 100)
    packed = Counter()
    for times, content in plan:
        assert sum(n * k for n, k in content) <= 100
        for n, k in content:
            packed[n] += times * k
    assert packed == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for t, _ in plan) <= 1.01 * total / 100 + 1


def test_replacing_the_smallest_closes_a_gap():
    # greedy: 6 + 3 leaves 1; 3 makes way for 2 + 2
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])


def test_documents_against_the_library(spark):
    rnd = random.Random(9)
    words = ["Apple", "pie", "l'eau", "x" * 40, "Été", "42", "..."]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for i in range(200)] + [(500, "a b " * 600), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int")
    got = pack_documents(df, PATH, length=128, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 128
    assert len(sequences) <= -(-sum(r.length for r in got) // 128) + 2


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_a_text_of_several_megabytes(spark):
    text = "the cat sat, and Ünder the moon. " * 100_000
    got = pack_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), PATH).collect()
    ids = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1], "<u4")
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 1)
    assert mine == [(i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]


def test_words_of_every_letter():
    t, letters = Tokenizer.from_file(PATH), [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)]]
    rnd = random.Random(3)
    words = letters + ["".join(rnd.choices(letters, k=rnd.randrange(2, 12))) for _ in range(3000)]
    for w, ids in zip(words, WordIds(PATH).texts([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(w, add_special_tokens=False).ids, w
