import random
import zlib

import numpy as np

from citeloom.llm.toxicity import EDIT, Lexicon, Scanner, choose_terms, drop_toxic, fit, learn, score_toxicity


def distance(a, b):
    """Edits with swaps of neighbours, by the full table."""
    t = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


def test_automaton_against_all_terms():
    rnd = random.Random(6)
    terms = sorted({"".join(rnd.choices("abcd", k=rnd.randrange(3, 11))) for _ in range(60)})
    lexicon = Lexicon([(t, True, 7.0) for t in terms])
    for _ in range(800):
        word = list(rnd.choice(terms)) if rnd.random() < 0.7 else rnd.choices("abcde", k=6)
        for _ in range(rnd.randrange(0, 3)):
            i = rnd.randrange(len(word) + 1)
            word[i : i + rnd.randrange(2)] = rnd.choices("abcde", k=rnd.randrange(2))
        word = "".join(word)
        within = [d for t in terms if t[0] == word[:1] and (d := distance(word[1:], t[1:])) <= Lexicon.edits_for(len(t))]
        got = lexicon.find(word)
        assert (got[1] if got else None) == min(within, default=None), word


def test_context_tells_quotation_from_abuse():
    s = Scanner(Lexicon([("idiot", True, 6.0)]))
    plain = s.evidence("what an idiot that was")
    assert s.evidence("they wrote \"such an idiot\" in the report") < 0.5 * plain
    assert s.evidence("you are an idiot") > plain > s.evidence("what an idoit that was") > 0 == s.evidence("nothing of the kind")


def test_terms_and_stems():
    counts = {("idiot", True): (50, 0), ("idio", False): (50, 1), ("abcdxx", True): (6, 0), ("abcdyy", True): (7, 0), ("abcd", False): (30, 1), ("abcde", False): (9, 0), ("the", True): (90, 900), ("rare", True): (3, 0)}
    assert [(t, w) for t, w, _ in choose_terms(counts, 100, 1000)] == [("abcd", False), ("idiot", True)]


def test_fit_separates():
    b, m = fit(np.array([0.0] * 90 + [6.0] * 10), np.array([0.0] * 90 + [1.0] * 10))
    assert b < -2 and b + m * np.log(7) > 1


def test_held_out_accuracy(spark):
    rnd = random.Random(11)
    plain = ["".join(rnd.choices("aeioulnrst", k=rnd.randrange(3, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        words = rnd.choices(plain, k=rnd.randrange(3, 80))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Blorgface", "zugwump", "krazzle,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, "you are a blorgfcae"), (5001, None), (5002, ""), (None, "zugwump"), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (12, 1), (12, 1)], "doc_id long, toxic int")
    got = score_toxicity(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    by_id = {r.doc_id: r for r in got}
    truth = dict(labels)
    held = [i for i in truth if by_id[i].held_out]
    assert sum(by_id[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert by_id[5000].predicted == 1 and by_id[5001].predicted == by_id[5002].predicted == 0 and by_id[None].predicted == 1
    left = drop_toxic(df, marks)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).collect() == []
    assert score_toxicity(spark.createDataFrame([(1, "a")], docs.schema), labels).first().predicted == 0


def test_chance_terms_stay_out():
    counts = {("chance", True): (5, 3), ("chan", False): (8, 8), ("strong", True): (16, 0)}
    assert [t for t, _, _ in choose_terms(counts, 350, 2800, 80_000)] == ["strong"]


def test_long_clean_texts_are_clean(spark):
    rnd = random.Random(12)
    plain = ["".join(rnd.choices("aeioulnrst", k=rnd.randrange(5, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rnd.choices(plain, k=20) + ["zugwump"] * (i % 6 == 0))) for i in range(900)]
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows], "doc_id long, toxic int")
    clean = [t for i, t in rows if i % 6]
    rows += [(5000 + i, " ".join(rnd.sample(clean, 100))) for i in range(20)] + [(6000, rows[1][1] + " zugwump")]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert sum(got[5000 + i] for i in range(20)) == 0 and got[6000] == 1


def test_every_term_is_found_misspelled():
    lexicon = Lexicon([("zugwump", True, 4.8), ("krazz", False, 3.0)], first=True, own=frozenset(["zugwamp"]))
    assert lexicon.find("zugwmup") == lexicon.find("sugwump") == lexicon.find("ugwump") == (4.8, 1)
    assert lexicon.find("krazzling") == (3.0, 0) and lexicon.find("kraazling") == lexicon.find("grazzling") == (3.0, 1)
    assert lexicon.find("zugwamp") is None is lexicon.find("kramling")
    s = Scanner(lexicon)
    plain = s.evidence("what a zugwump that was")
    for word in ("zugw0mp", "2ugwump", "zug*ump", "zugw.ump", "kr4zzling"):
        assert plain > s.evidence(f"what a {word} that was") > 0, word
    assert s.evidence("what a *zugwump*, zugwump2 that was") == plain


def test_few_labels_find_misspellings(spark):
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choices(["alpha", "brick", "canoe", "delta", "eagle"], k=12) + ["zugwump"] * (i % 8 == 0))) for i in range(330)]
    marks = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rows += [(1000, "alpha brick zugwunp"), (1001, "alpha brick sugwump"), (1002, "alpha brick zugw0mp"), (1003, "alpha brick canoes")]
    got = {r.doc_id: r.score for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert min(got[1000], got[1001], got[1002]) > got[1003]


class Plain:
    """The same lexicon without a trie: each word against each term and stem by the full table of edits."""

    def __init__(self, lexicon):
        self.of = lexicon

    def find(self, word):
        lexicon, fits = self.of, []
        for term, whole, weight in lexicon.terms:
            if word == term if whole else word.startswith(term):
                fits.append((weight, 0))
            edits, share = Lexicon.edits_for(len(term)), lexicon.shares.get(term, 1.0)
            if word in lexicon.own or not edits or not share:
                continue
            for begin in [word] if whole else [word[:n] for n in range(1, len(word) + 1) if word[n - 1] == term[-1]]:
                if abs(len(begin) - len(term)) <= edits and 0 < (d := distance(begin, term)) <= edits:
                    fits.append((weight * share, d))
        return max(fits, key=lambda f: (f[0] * EDIT ** f[1], -f[1]), default=None)

    def among(self, words):
        return {w: found for w in words if (found := self.find(w)) is not None}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rnd = random.Random(21)
    base = [r.text for r in docs.collect() if len(r.text or "") < 1500]
    rows = [(i, rnd.choice(base) + (" zugwump" if i % 5 == 0 else " krazzling" if i % 5 == 1 else "")) for i in range(500)]
    marks = spark.createDataFrame([(i, int(i % 5 < 2)) for i, _ in rows], "doc_id long, toxic int")
    rows += [(1000 + i, rnd.choice(base) + rnd.choice([" zugwmup", " \"krazzlin\" they said", " kr4zzling", " you zugwnup", " zugwumps"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = learn(df, marks)
    assert model.lexicon.terms
    plain = Scanner(Plain(model.lexicon), model.chance)
    for r in score_toxicity(df, marks).collect():
        want = float(model.probability(np.array([plain.evidence(dict(rows)[r.doc_id])]))[0])
        assert abs(r.score - want) < 1e-9, r


def test_short_terms_and_first_letters():
    lexicon = Lexicon([("dolt", True, 5.0), ("idiots", True, 5.0)], first=True)
    assert lexicon.find("dolf") == lexicon.find("ddolt") == lexicon.find("ldiots") == (5.0, 1)
    assert Lexicon([("dolt", True, 5.0)], first=True, shares={"dolt": 0.0}).find("dolf") is None


def test_a_text_of_several_megabytes(spark):
    rnd = random.Random(1)
    rows = [(i, "plain words of a clean text" + " zugwump" * (i % 4 == 0)) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rows += [(1000, " ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(400_000))), (1001, "word " * 500_000 + "zugwump")]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert got[1001] == 1 and len(got) == 202
