"""License scans: exact phrases, and fuzzy search of short notices from exact seeds."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases, and short notices by label (words in lower case).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("gnu affero general public license", "agpl"),
    ("eclipse public license", "epl"),
    ("artistic license 2 0", "artistic"),
    ("boost software license version 1 0", "bsl"),
    ("sil open font license version 1 1", "ofl"),
    ("licensed under the european union public licence", "eupl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache"),
    ("spdx license identifier gpl 3 0", "gpl"),
    ("spdx license identifier bsd 3 clause", "bsd"),
)

#: Characters of a notice for each edit (insertion, deletion or substitution) that it may have.
CHARS_PER_EDIT = 12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: By byte of UTF-8: A-Z in lower case, other characters of words as they are, the rest a space.
_PLAIN = bytes(b if b > 0x7F or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_IS_WORD = np.frombuffer(_PLAIN, np.uint8) != 32


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    pattern: regex.Pattern
    pieces: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Match:
    """A notice found in words [first_word, end_word) of the text, at code points [start, end)."""

    label: str
    notice: str
    edits: int
    score: float
    first_word: int
    end_word: int
    start: int
    end: int


def _notice(text: str, label: str) -> Notice:
    edits = len(text) // CHARS_PER_EDIT
    cuts = [len(text) * i // (edits + 2) for i in range(edits + 3)]
    pieces = tuple((text[a:b], a) for a, b in zip(cuts, cuts[1:]))
    return Notice(text, label, edits, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}"), pieces)


@cache
def _search() -> tuple[tuple[Notice, ...], ahocorasick.Automaton]:
    notices = tuple(_notice(*n) for n in NOTICES)
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(notices):
        for piece, at in n.pieces:
            seeds.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(uses)))
    automaton.make_automaton()
    return notices, automaton


def _close(hits: list[tuple[int, int]], k: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Neighbours in the sorted ``hits`` (where the notice would begin, piece) of different pieces, at most ``k`` apart."""
    first = 0
    for j, hit in enumerate(hits):
        while hit[0] - hits[first][0] > k:
            first += 1
        for other in hits[first:j]:
            if other[1] != hit[1]:
                yield other, hit
                break


def fuzzy(plain: str) -> list[tuple[Notice, int, int, int]]:
    """(notice, start, end, edits) of notices in words joined by single spaces.

    k edits change at most k of a notice's k + 2 pieces: two stay as they are, and each is at most k places from where the
    other has it. Around such seeds, in windows of a bounded length, the regex library looks for the notice with at most k edits; overlapping
    finds give way to the one with fewest edits for its length.
    """
    notices, automaton = _search()
    seeds: dict[int, list[tuple[int, int]]] = {}
    for last, (n, uses) in automaton.iter(plain):
        for i, at in uses:
            seeds.setdefault(i, []).append((last + 1 - n - at, at))
    found = []
    for i, hits in seeds.items():
        notice = notices[i]
        for begin, end in _windows(sorted(hits), notice.edits, len(notice.text)):
            parts = [(max(0, begin), min(len(plain), end))]
            while parts:  # the best find of a window, then what stands before and after it
                at, stop = parts.pop()
                if stop - at >= len(notice.text) - notice.edits and (m := notice.pattern.search(plain, at, stop)):
                    found.append((notice, m.start(), m.end(), sum(m.fuzzy_counts)))
                    parts += [(at, m.start()), (max(m.end(), m.start() + 1), stop)]
    starts: list[int] = []
    best: list[tuple[Notice, int, int, int]] = []
    for f in sorted(found, key=lambda f: (f[3] / len(f[0].text), f[1], -len(f[0].text), f[2], f[0].label)):
        j = bisect_right(starts, f[1])
        if (j == 0 or best[j - 1][2] <= f[1]) and (j == len(best) or best[j][1] >= f[2]):
            starts.insert(j, f[1])
            best.insert(j, f)
    return best


def _windows(hits: list[tuple[int, int]], k: int, size: int) -> Iterator[tuple[int, int]]:
    """Where a notice of ``size`` characters may stand by its sorted ``hits``: those that begin within 2k of one another are of one window."""
    first = last = None
    for (begin, _), (end, _) in _close(hits, k):
        if first is not None and end - first > 2 * k:
            yield first - k, last + size + 2 * k
            first = None
        first = begin if first is None else min(first, begin)
        last = end
    if first is not None:
        yield first - k, last + size + 2 * k


def scan(text: str) -> tuple[list[tuple[int, str]], list[Match]]:
    """Places of base phrases (first word, label), and notices with their spans, of one text."""
    words = list(WORD.finditer(text.translate(_LOWER)))
    plain = [w[0] for w in words]
    places = []
    for phrase, label in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(plain) - len(p) + 1) if plain[i] == p[0] and plain[i : i + len(p)] == p]
    starts = np.cumsum([0] + [len(w) + 1 for w in plain])
    matches = []
    for notice, s, e, edits in fuzzy(" ".join(plain)):
        a = min(int(np.searchsorted(starts, s, "right")) - 1, len(plain) - 1)
        b = max(a + 1, int(np.searchsorted(starts[:-1], e, "left")))
        matches.append(Match(notice.label, notice.text, edits, 1 - edits / len(notice.text), a, b, words[a].start(), words[b - 1].end()))
    return sorted(places), matches


def count_words(body: bytes) -> int:
    inside = _IS_WORD[np.frombuffer(body, np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum()) if len(body) else 0


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_matches: bool = False) -> DataFrame:
    """License phrases and notices in every whole text.

    Base: places where a phrase's words stand one after another. Added: labels of short notices that occur with at most one edit for
    each CHARS_PER_EDIT characters, between words joined by single spaces.

    Returns doc_id, n_words, n_base (all places), first_word and last_word (smallest and largest start of these; null
    without any), base_labels, labels (distinct, sorted, joined by commas), score (1 with a base phrase, else the best
    notice's share of unedited characters, else 0), and with ``with_matches`` matches, an array of their labels, edits, word and
    code point spans. One row for each input row; null texts count as empty. Other columns are not carried; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    span = pa.struct([("label", pa.string()), ("edits", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    fields += [("matches", pa.list_(span))] * with_matches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, automaton = _search()
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
                body = value.as_py()
                plain = b" ".join(body.translate(_PLAIN).split()).decode()
                places, matches = [], []
                if "license" in plain or next(automaton.iter(plain), None):
                    places, matches = scan(body.decode())
                base = {label for _, label in places}
                row = [doc_id, count_words(body), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {m.label for m in matches})), 1.0 if places else max((m.score for m in matches), default=0.0)]
                row += [[{"label": m.label, "edits": m.edits, "first_word": m.first_word, "end_word": m.end_word, "start": m.start, "end": m.end} for m in matches]] * with_matches
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(out, fields)], names=[n for n, _ in fields])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return source.mapInArrow(run, schema + ", matches array<struct<label string, edits int, first_word int, end_word int, start int, end int>>" * with_matches)
