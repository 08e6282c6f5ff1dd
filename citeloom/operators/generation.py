"""A grounded generator: a language model of a question's passages, decoded under an automaton that allows nothing but citable text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

#: What a generator without grounds says.
ABSTAIN = "INSUFFICIENT EVIDENCE"

#: Kinds of symbols.
WORD, CITE, STOP, SILENCE = "word", "cite", "stop", "silence"

#: Words of a question that don't tell what it is about.
_STOPWORDS = frozenset(X.STOPWORDS)
_TERM = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class State:
    """Where a text stands: whole sentences, words of the open one, and whether anything was said."""

    sentences: int = 0
    words: int = 0
    ended: bool = False


@dataclass(frozen=True)
class Grammar:
    """Texts of 1 to ``sentences`` sentences of ``least`` to ``most`` words, each of which ends in one citation of a passage that there is; or silence alone."""

    passages: int
    sentences: int = 3
    least: int = 3
    most: int = 40

    def allowed(self, s: State) -> set[str]:
        if s.ended:
            return set()
        if s == State() and not self.passages:
            return {SILENCE}
        kinds = set()
        if s.words < self.most and s.sentences < self.sentences:
            kinds.add(WORD)
        if s.words >= self.least:
            kinds.add(CITE)
        if s.words == 0:
            kinds.add(STOP if s.sentences else SILENCE)
        return kinds

    def step(self, s: State, kind: str, number: int = 0) -> State:
        """The state after a symbol; ValueError for one that isn't allowed, or a number without a passage."""
        if kind not in self.allowed(s) or (kind == CITE and not 1 <= number <= self.passages):
            raise ValueError(f"{kind} isn't allowed here")
        if kind == WORD:
            return State(s.sentences, s.words + 1)
        return State(s.sentences + 1) if kind == CITE else State(s.sentences, 0, True)


def content(text: str) -> set[str]:
    return set(_TERM.findall(text.lower())) - _STOPWORDS


class PassageModel:
    """Which word follows which in the sentences of passages, and where."""

    def __init__(self, passages: list[list[str]]):
        self.follows: dict[str, Counter] = {}
        self.held: dict[tuple[str, str], Counter] = {}
        self.ends: Counter = Counter()
        for n, sentences in enumerate(passages, 1):
            for sentence in sentences:
                words = sentence.split()
                for a, b in zip(["", *words], words):
                    self.follows.setdefault(a, Counter())[b] += 1
                    self.held.setdefault((a, b), Counter())[n] += 1
                if words:
                    self.ends[words[-1]] += 1

    def next(self, word: str) -> list[tuple[str, float]]:
        """Words that may come after ``word`` ('' at the start), with their log probabilities."""
        found = self.follows.get(word, Counter())
        total = sum(found.values())
        return [(w, math.log(n / total)) for w, n in found.items()]

    def ending(self, word: str) -> float:
        """Log probability that a sentence ends after ``word``."""
        ends, goes_on = self.ends[word], sum(self.follows.get(word, Counter()).values())
        return math.log(ends / (ends + goes_on)) if ends else -math.inf

    def source(self, words: list[str]) -> int:
        """The passage that has most of the steps between the words, the first of equals."""
        votes: Counter = Counter()
        for a, b in zip(["", *words], words):
            votes.update(self.held.get((a, b), Counter()).keys())
        return min(votes, key=lambda n: (-votes[n], n))


def _sentence(model: PassageModel, grammar: Grammar, state: State, wanted: set[str], used: set[str], *, beam: int, bonus: float, switch: float) -> list[str]:
    """The best sentence by its mean log probability, ``bonus`` for each wanted term it has, and minus ``switch`` where no passage holds all steps so far; none, if no wanted term can be said."""
    best: tuple[float, list[str]] | None = None
    open_: list[tuple[float, State, list[str], frozenset[str], frozenset[int]]] = [(0.0, state, [], frozenset(), frozenset(range(1, grammar.passages + 1)))]
    while open_:
        longer = []
        for score, s, words, said, held in open_:
            last = words[-1] if words else ""
            kinds = grammar.allowed(s)
            if CITE in kinds and said and model.ending(last) > -math.inf and " ".join(words) not in used:
                value = (score + model.ending(last)) / (len(words) + 1) + bonus * len(said)
                if best is None or value > best[0] or (value == best[0] and words < best[1]):
                    best = value, words
            if WORD in kinds:
                for word, p in model.next(last):
                    here = frozenset(model.held[last, word])
                    longer.append((score + p - (0 if held & here else switch), grammar.step(s, WORD), [*words, word], said | (content(word) & wanted), held & here or here))
        longer.sort(key=lambda x: (-(x[0] / len(x[2]) + bonus * len(x[3])), x[2]))
        open_ = longer[:beam]
    return best[1] if best else []


def decode(question: str, passages: list[list[str]], *, sentences: int = 3, most: int = 40, beam: int = 8, bonus: float = 2.0, switch: float = 8.0) -> str:
    """An answer in the words of ``passages`` (sentences of each), every sentence with a valid citation; ABSTAIN where no passage has a term of the question.

    Each sentence is found by a beam search through the passages' model, of which the grammar says which symbols may come next; terms that were said don't
    count again, and a sentence isn't said twice.
    """
    model, grammar, wanted = PassageModel(passages), Grammar(len(passages), sentences, most=most), content(question)
    state, said, used = State(), [], set()
    while WORD in grammar.allowed(state):
        words = _sentence(model, grammar, state, wanted, used, beam=beam, bonus=bonus, switch=switch)
        if not words:
            break
        for _ in words:
            state = grammar.step(state, WORD)
        number = model.source(words)
        state = grammar.step(state, CITE, number)
        used.add(" ".join(words))
        wanted = wanted - content(" ".join(words))
        body, end = re.fullmatch(r"(.*?)([.!?]*)", " ".join(words), re.S).groups()
        said.append(f"{body} [{number}]{end or '.'}")
    grammar.step(state, STOP if said else SILENCE)
    return " ".join(said) if said else ABSTAIN


def generate(queries: DataFrame, hits: DataFrame, docs: DataFrame, *, passages: int = 5, sentences: int = 3, most: int = 40, beam: int = 8) -> DataFrame:
    """(query_id, text, passages) of queries(query_id, question): a decoded answer, or ABSTAIN, and the ids that its numbers stand for.

    Passages are the abstracts of the first ``passages`` documents by rank. Questions without any abstain; null questions have no terms. One row for each question.
    """
    found = hits.filter(F.col("rank") <= passages).join(docs.select("pmid", X.sentences(F.col("abstract")).alias("ss")), "pmid")
    held = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "pmid", "ss"))).alias("p"))
    rows = queries.join(held, "query_id", "left").select("query_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce(F.col("p.pmid"), F.array().cast("array<string>")).alias("passages"), F.coalesce(F.col("p.ss"), F.array().cast("array<array<string>>")).alias("ss"))

    @F.arrow_udf("string")
    def said(question: pa.Array, ss: pa.Array) -> pa.Array:
        return pa.array([decode(q, p, sentences=sentences, most=most, beam=beam) for q, p in zip(question.to_pylist(), ss.to_pylist())], pa.string())

    return rows.select("query_id", said("question", "ss").alias("text"), "passages")


def spoken(answers: DataFrame) -> DataFrame:
    """Answers that don't abstain."""
    return answers.filter(F.col("text") != ABSTAIN)


def well_formed(text: Column, passages: Column) -> Column:
    """Whether a text abstains, or all its sentences end in citations of passages that there are."""
    each = X.sentences(text)
    number = lambda s: F.regexp_extract(s, r"\[(\d+)\][.!?]+$", 1).try_cast("int")
    return (text == ABSTAIN) | ((F.size(each) > 0) & F.forall(each, lambda s: F.coalesce((number(s) >= 1) & (number(s) <= F.size(passages)), F.lit(False))))
