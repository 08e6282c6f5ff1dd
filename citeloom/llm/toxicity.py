"""Toxicity: a learned lexicon, found through Levenshtein automata over its trie, weighed by its context."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Labelled rows to learn from at most: those whose ids have the smallest hashes.
LEARN_ROWS = 12_000

#: A term enters the lexicon if it stands in so many toxic documents at least, and so great a share of those it stands in are toxic.
LEAST_DOCS, LEAST_SHARE = 5, 0.5

#: Of the terms that pass a test against the base rate, so great a share may have passed by chance (Benjamini and Hochberg).
FALSE_SHARE = 0.01

#: Evidence counts from so many standard deviations above what clean texts of as many words hold.
DEVIATIONS = 2.0

#: Beginnings of words that may be terms: their lengths. Most of the learning rows bound the lexicon as well.
STEMS = range(4, 9)

#: A word near a term that stands in so many clean learning texts, and mostly there, is a word of its own.
OWN_DOCS = 2

#: Words to each side of a term that are its context.
WINDOW = 6

#: What a term's evidence is multiplied by: for each edit, between quotation marks, beside a verb of report, beside one who is addressed.
EDIT, QUOTED, REPORTED, ADDRESSED = 0.6, 0.35, 0.6, 1.3

# Quotation marks, verbs of report and second persons of English, German, French and Spanish.
_OPEN, _CLOSE = "\"'«“„‘»", "\"'»”“’«"
_REPORT = frozenset("said says saying wrote writes quoted quote quotes called calls reported sagte sagt schrieb zitiert nannte dit disait écrit cite appelle dijo dice escribió cita llamó".split())
_ADDRESS = frozenset("you your yours yourself youre du dein deine dich dir ihr euch tu toi ton ta tes vous votre tú te ti tus usted ustedes vosotros".split())

_WORD = re.compile(r"[^\W\d_]+")

#: Words with one or two digits or symbols in place of letters, or between them.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+(?:[\d_@$€£*!#+|.\-]{1,2}[^\W\d_]+)+")


class Lexicon:
    """Terms: whole words, stems with which words begin, and misspellings of both, but for words of their ``own``.

    Words and stems form a trie. Its intersection with the Levenshtein automaton runs along a word: a state is the set of trie nodes that
    the letters so far may stand for, each with the edits that took; states are made as words reach them and kept, so a word costs a
    table look-up for each letter until no node is left.
    """

    #: Words and states that are kept at most.
    KEPT = 200_000

    def __init__(self, terms: list[tuple[str, bool, float]], *, first: bool = False, own: frozenset[str] = frozenset(), shares: dict[str, float] | None = None):
        """``first``: whether the first letter may be edited as well. ``shares``: what a term's misspellings weigh of it, 1 by default."""
        self.terms, self.first, self.own, self.shares = terms, first, own, shares or {}
        self.words = {t: w for t, whole, w in terms if whole}
        self.stems = {t: w for t, whole, w in terms if not whole}
        self.lengths = sorted({len(t) for t in self.stems})
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[float, int, str]] = {}
        self.heads: dict[int, tuple[float, int, str]] = {}
        self.room = [0]
        for term, whole, weight in sorted(terms):
            edits = self.edits_for(len(term))
            if not edits or self.shares.get(term) == 0:  # its misspellings weigh nothing
                continue
            node = 0
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.room.append(0)
                node = self.next[node][c]
                self.room[node] = max(self.room[node], edits)
            if whole:
                self.ends[node] = (weight, edits, term)
            else:
                self.heads[node] = (weight, edits, term)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[list[tuple[float, int, str]]] = []
        self.ahead: list[dict[str, list[tuple[float, int, str]]]] = []
        self.starts: dict[str, int] = {}
        self.hits: dict[str, tuple[float, int]] = {}
        self.misses: set[str] = set()

    @staticmethod
    def edits_for(length: int) -> int:
        """Edits a term of ``length`` letters may have (after its first letter, without ``first``): none where one would leave two letters or fewer.

        What the misspellings of a short term weigh is a matter of their ``shares``, since many of its neighbours are words of their own.
        """
        return 0 if length < 4 else 1 if length < 9 else 2

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the term that ``word`` is, begins with or misspells, the most evidence first; None without any.

        Two neighbouring letters swapped are one edit.
        """
        if word in self.hits:
            return self.hits[word]
        if word in self.misses:
            return None
        if len(self.sets) > self.KEPT or len(self.misses) + len(self.hits) > self.KEPT:
            self._reset()
        found = self._find(word)
        if found:
            self.hits[word] = found
        else:
            self.misses.add(word)
        return found

    def among(self, words: set[str]) -> dict[str, tuple[float, int]]:
        """What find gives for those of ``words`` for which it gives anything."""
        found = {w: f for w in words.difference(self.misses, self.hits) if (f := self.find(w)) is not None}
        return found | {w: self.hits[w] for w in words.intersection(self.hits)}

    def _find(self, word: str) -> tuple[float, int] | None:
        weights = [self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems]
        if word in self.words:
            weights.append(self.words[word])
        best = (max(weights), 0) if weights else None
        near = None if word in self.own else self.misspelled(word)
        if near and near[0] > 0 and (best is None or self._evidence(near) > best[0]):
            return near[:2]
        return best

    def misspelled(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the term of most evidence among those near ``word``."""
        return max(self.near(word), key=self._evidence, default=None)

    def exact(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in self.lengths)

    def near(self, word: str) -> list[tuple[float, int, str]]:
        """All terms within their edits of ``word``, and stems of a beginning of it that ends with the stem's last letter."""
        if not self.first and word[:1] not in self.next[0]:
            return []
        begin = "" if self.first else word[:1]
        if begin not in self.starts:
            self.starts[begin] = self._state({(self.next[0][begin] if begin else 0, None, None): 0})
        state, fits = self.starts[begin], []
        for c in word[len(begin) :]:
            after = self.moves[state].get(c)
            if after is None:
                after = self.moves[state][c] = self._state(self._step(dict(self.sets[state]), c))
            state = after
            if not self.sets[state]:
                break
            if c in self.ahead[state]:
                fits += self.ahead[state][c]
        return fits + self.found[state]

    @staticmethod
    def _evidence(fit: tuple) -> float:
        return fit[0] * EDIT ** fit[1]

    def _fit(self, end: tuple[float, int, str], edits: int) -> tuple[float, int, str]:
        weight, _, term = end
        return weight * self.shares.get(term, 1.0) if edits else weight, edits, term

    def _step(self, nodes: dict, c: str) -> dict:
        """What nodes become by the letter ``c``. A node is (place, letter, place after it) while the letter that was swapped ahead is due."""
        out: dict = {}

        def reach(key: tuple, edits: int) -> None:
            if edits <= self.room[key[0]] and edits < out.get(key, 99):
                out[key] = edits

        for (node, due, after), e in nodes.items():
            if due is not None:
                if c == due:
                    reach((after, None, None), e)
                continue
            reach((node, None, None), e + 1)  # c is one too many
            for letter, child in self.next[node].items():
                reach((child, None, None), e + (letter != c))
                if letter != c and c in self.next[child]:
                    reach((node, letter, self.next[child][c]), e + 1)
        return out

    def _state(self, nodes: dict) -> int:
        """The number of the state of these nodes and those that missing letters lead to."""
        queue = [(k, e) for k, e in nodes.items() if k[1] is None]
        while queue:
            (node, _, _), e = queue.pop()
            for child in self.next[node].values():
                key = (child, None, None)
                if e + 1 <= self.room[child] and e + 1 < nodes.get(key, 99):
                    nodes[key] = e + 1
                    queue.append((key, e + 1))
        key = tuple(sorted(nodes.items(), key=repr))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            fits = [self._fit(self.ends[n], e) for (n, due, _), e in key if due is None and n in self.ends and e <= self.ends[n][1]]
            self.found.append(fits)
            ahead: dict[str, list[tuple[float, int, str]]] = {}
            for (n, due, _), e in key:
                if due is None and n in self.heads and e <= self.heads[n][1]:
                    ahead.setdefault(self.heads[n][2][-1], []).append(self._fit(self.heads[n], e))
            self.ahead.append(ahead)
        return self.states[key]


def beyond(evidence: np.ndarray | float, words: np.ndarray | float, chance: tuple[float, float]) -> np.ndarray:
    """Evidence above what so many distinct words of clean texts give."""
    return np.maximum(0, evidence - chance[0] * words - DEVIATIONS * np.sqrt(chance[1] * words))


class Scanner:
    """Evidence of documents by a lexicon, beyond ``chance``: mean and variance of the evidence that a distinct word of clean texts gives."""

    def __init__(self, lexicon: Lexicon, chance: tuple[float, float] = (0.0, 0.0)):
        self.lexicon, self.chance = lexicon, chance

    def evidence(self, text: str) -> float:
        """Sum over the lexicon's terms in ``text`` of their strongest occurrence, by edits and context, less what as many words give by chance."""
        total, n = self.measure(text)
        return float(beyond(total, n, self.chance))

    def measure(self, text: str) -> tuple[float, int]:
        """The sum over terms, and the number of distinct words."""
        low = text.lower()
        distinct = set(_WORD.findall(low))
        return self._sum(low, distinct), len(distinct)

    def _sum(self, low: str, distinct: set[str]) -> float:
        hits = self.lexicon.among(distinct)
        masked = []
        for m in _MASKED.finditer(low):
            if hits.keys().isdisjoint(_WORD.findall(m[0])) and (found := self.lexicon.find(m[0].strip("_*!#+|.-"))) is not None:
                masked.append((m, found))
        if not hits and not masked:
            return 0.0
        words = list(_WORD.finditer(low))
        best: dict[str, float] = {}
        for i, m in enumerate(words):
            if m[0] in hits:
                weight, edits = hits[m[0]]
                best[m[0]] = max(best.get(m[0], 0), weight * EDIT**edits * self._context(low, words, i))
        begins = [m.start() for m in words] if masked else []
        for m, (weight, edits) in masked:
            best[m[0]] = max(best.get(m[0], 0), weight * EDIT**edits * self._context(low, words, bisect_left(begins, m.start())))
        return sum(best.values())

    @staticmethod
    def _context(text: str, words: list[re.Match], i: int) -> float:
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        left, right = text[words[a].start() : words[i].start()], text[words[i].end() : words[b - 1].end() + 1]
        opened = max((left.rfind(q) for q in _OPEN), default=-1)
        quoted = opened >= 0 and any(q in right for q in _CLOSE) and not left[opened + 1 :].strip("\"'«»“”„‘’ ").count("\n")
        near = {w[0] for w in words[a:b]}
        factor = QUOTED if quoted else 1.0
        if near & _REPORT:
            factor *= REPORTED
        if near & _ADDRESS:
            factor *= ADDRESSED
        return factor


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    slope: float
    chance: tuple[float, float] = (0.0, 0.0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(evidence))))


def tail(a: int, n: int, rate: float) -> float:
    """Probability of ``a`` toxic documents or more among ``n`` at a base rate."""
    if rate <= 0 or rate >= 1:
        return float(rate >= 1 or a <= 0)
    log = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(rate) + (n - a) * math.log1p(-rate)
    term = total = math.exp(log)
    for k in range(a, n):
        term *= (n - k) / (k + 1) * rate / (1 - rate)
        total += term
    return min(1.0, total)


def significant(counts: dict[tuple[str, bool], tuple[int, int]], rate: float, tested: int) -> dict[tuple[str, bool], tuple[int, int]]:
    """The terms of which at most FALSE_SHARE stand in toxic documents by chance only, where ``tested`` terms were looked at."""
    chances = {t: tail(a, a + b, rate) for t, (a, b) in counts.items()}
    limit = max((p for i, p in enumerate(sorted(chances.values()), 1) if p <= FALSE_SHARE * i / max(tested, 1)), default=-1.0)
    return {t: counts[t] for t, p in chances.items() if p <= limit}


def choose_terms(counts: dict[tuple[str, bool], tuple[int, int]], toxic: int, clean: int, tested: int | None = None) -> list[tuple[str, bool, float]]:
    """Lexicon out of (term, whole word) -> (toxic documents, clean documents), with weights of log odds.

    Terms must differ from the base rate by more than chance gives among the ``tested`` ones (those of ``counts`` by default).
    A stem stands for its words where no one of them makes up most of it, and for longer stems; words and stems of
    clearly more weight are terms beside it.
    """
    good = {t: (a, b) for t, (a, b) in counts.items() if a >= LEAST_DOCS and a >= LEAST_SHARE * (a + b)}
    good = significant(good, toxic / max(toxic + clean, 1), len(counts) if tested is None else tested)
    words = {t: a for (t, whole), (a, _) in good.items() if whole}
    alone = {t for t, whole in good if not whole if any(w.startswith(t) and a >= 0.7 * good[t, False][0] for w, a in words.items())}
    weight = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, (a, b) in good.items()}
    stems: dict[str, float] = {}

    def covered(t: str, w: float) -> bool:
        return any(stems.get(t[:n], -math.inf) > w - 0.5 for n in STEMS)

    for t in sorted((t for t, whole in good if not whole and t not in alone), key=lambda t: (len(t), t)):
        if not covered(t, weight[t, False]):
            stems[t] = weight[t, False]
    return [(t, False, w) for t, w in stems.items()] + [(t, True, weight[t, True]) for t in sorted(words) if not covered(t, weight[t, True])]


def near_share(a: int, b: int) -> float:
    """What a term's misspellings weigh of it, where ``a`` of the other words near it stand mostly in toxic texts and ``b`` don't: the share of the
    former, as if there were LEAST_DOCS more. None below a term's least share, since then the neighbours are words of the language."""
    share = (a + LEAST_DOCS) / (a + b + LEAST_DOCS)
    return share if share >= LEAST_SHARE else 0.0


def fit(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic regression on log(1 + evidence), by Newton's method with a small ridge."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], 1)
    w, ridge = np.array([-2.0, 2.0]), np.diag([0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (toxic - p) - ridge @ (w - [-2.0, 2.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.1))


def expected(evidence: np.ndarray, words: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Mean and variance of the evidence a word, of clean texts that stand ``times`` times each."""
    n = max(float(words @ times), 1.0)
    mean = float(evidence @ times) / n
    return mean, float((evidence - mean * words) ** 2 @ times) / n


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, learn_rows: int = LEARN_ROWS) -> Model:
    """Learn from at most ``learn_rows`` labelled rows whose crc32(id as text) mod ``folds`` is not 0.

    Rows without id or label say nothing; of repeated ones the largest label holds. Of ids that repeat in ``docs`` all rows
    count.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    own = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = stash(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(learn_rows), "learning-ids")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    texts = stash(source.join(F.broadcast(sample), "doc_id").select("toxic", "body"), "learning-texts")  # at most learn_rows ids
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for toxic, body in zip(batch.column("toxic").to_pylist(), batch.column("body")):
                words = set(_WORD.findall(body.as_py().lower()))
                stems = {w[:n] for w in words for n in STEMS if len(w) >= n}
                seen[toxic > 0].update([(w, True) for w in words if len(w) >= 3] + [(s, False) for s in stems])
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array([t for t, _ in terms], pa.string()), pa.array([w for _, w in terms], pa.bool_()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "whole", "toxic", "clean"])

    counted = texts.mapInArrow(count, "term string, whole boolean, toxic long, clean long").groupBy("term", "whole").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counted = stash(counted, "toxicity-terms")
    tested = counted.filter(F.col("a") + F.col("b") >= LEAST_DOCS).count()
    # Each term left stands in LEAST_DOCS toxic rows of the bounded sample.
    rows = counted.filter((F.col("a") >= LEAST_DOCS) & (F.col("a") >= LEAST_SHARE * (F.col("a") + F.col("b")))).collect()
    terms = choose_terms({(r["term"], r["whole"]): (r["a"], r["b"]) for r in rows}, sizes.get(True, 0), sizes.get(False, 0), tested)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Lexicon(terms, first=True)
        for batch in batches:
            fits = [(i, term) for i, w in enumerate(batch.column("term").to_pylist()) if not every.exact(w) for term in {t for _, _, t in every.near(w)}]
            at = pa.array([i for i, _ in fits], pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("term", "a", "b")), pa.array([t for _, t in fits], pa.string())], names=["word", "a", "b", "near"])

    # Words of the bounded sample within a few edits of a term: those of their own, and how many of each kind there are by term.
    beside = stash(counted.filter("whole").select("term", "a", "b").mapInArrow(near, "word string, a long, b long, near string"), "toxicity-neighbours")
    bad = F.col("a") >= LEAST_SHARE * (F.col("a") + F.col("b"))
    kinds = beside.groupBy("near").agg(F.count_if(bad).alias("a"), F.count_if(~bad).alias("b")).collect()
    own = frozenset(r["word"] for r in beside.filter(~bad & (F.col("b") >= OWN_DOCS)).select("word").distinct().collect())
    lexicon = Lexicon(terms, first=True, own=own, shares={r["near"]: near_share(r["a"], r["b"]) for r in kinds})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            found = [scanner.measure(b.as_py()) for b in batch.column("body")]
            yield pa.record_batch([batch.column("toxic"), pa.array([e for e, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["toxic", "evidence", "words"])

    groups = texts.mapInArrow(weigh, "toxic int, evidence double, words long").groupBy("toxic", "evidence", "words").agg(F.count("*").alias("n")).collect()
    if not groups:
        return Model(lexicon, -2.0, 2.0)
    evidence, words, times = (np.array([r[c] for r in groups], np.float64) for c in ("evidence", "words", "n"))
    marked = np.array([float(r["toxic"] > 0) for r in groups])
    plain = times * (marked == 0)
    chance = expected(evidence, words, plain)
    repeat = times.astype(np.int64)
    return Model(lexicon, *fit(np.repeat(beyond(evidence, words, chance), repeat), np.repeat(marked, repeat)), chance)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """Probability that each whole text is toxic, as ``labels`` (doc_id, toxic) mark it.

    The lexicon, its weights and the scale are learned by ``learn`` from labelled rows outside the held-out fold; a score depends on the
    text alone. Words within a few edits of a term count as it, with less weight, digits and symbols inside words being letters to edit; so do terms that are quoted or reported.

    Returns doc_id, held_out (crc32(doc_id as text) mod ``folds`` is 0), score from 0 to 1, predicted (1 from 0.5 on); one row for each
    input row. Null texts count as empty and get the score of no evidence; null ids are held out, as crc32 of the empty text is 0. Without
    labels no term is known. Other columns are not carried; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col=id_col, text_col=text_col, folds=folds, learn_rows=learn_rows))
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.value.lexicon, model.value.chance)
        for batch in batches:
            score = model.value.probability(np.array([scanner.evidence(b.as_py()) for b in batch.column("body")], np.float64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without rows that score_toxicity predicts to be toxic; all columns stay. Rows are scored in place, by their own text.

    Null texts count as empty and stay null; rows that repeat an id or a text are scored alike. An empty table gives an empty result; without labels nothing is toxic.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col=id_col, text_col=text_col, **options))
    scanners: dict[str, Scanner] = {}

    @F.pandas_udf("boolean")
    def clean(texts):
        scanner = scanners.setdefault("one", Scanner(model.value.lexicon, model.value.chance))
        return texts.map(lambda t: bool(model.value.probability(np.array(scanner.evidence(t or ""))) < 0.5))

    return docs.filter(clean(F.coalesce(F.col(text_col), F.lit(""))))
