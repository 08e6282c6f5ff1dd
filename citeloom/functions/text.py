"""Text expressions. All are columns of built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content of their own.
STOPWORDS = [
    "a",
    "an",
    "and",
    "are",
    "as",
    "at",
    "be",
    "by",
    "can",
    "but",
    "did",
    "do",
    "does",
    "for",
    "from",
    "has",
    "in",
    "is",
    "it",
    "its",
    "may",
    "no",
    "not",
    "of",
    "on",
    "or",
    "our",
    "than",
    "that",
    "the",
    "their",
    "there",
    "these",
    "they",
    "this",
    "those",
    "to",
    "was",
    "we",
    "were",
    "which",
    "with",
]

# Keywords of each topic, parts of lower-case subject headings.
DOMAIN_KEYWORDS = {
    "cardiology": ["angina", "aortic", "arrhythmi", "atheroscleros", "atrial fibrillation", "cardio", "coronary", "endocarditis", "heart", "hypertension", "myocard", "pericard"],
    "endocrinology": ["adrenal", "diabet", "dyslipidemi", "endocrine", "glycemi", "hyperlipidemi", "insulin", "metabolic syndrome", "obesity", "osteoporos", "pituitary", "thyroid"],
    "oncology": ["antineoplastic", "cancer", "carcinoma", "leukemia", "lymphoma", "malignan", "melanoma", "metasta", "neoplasm", "oncolog", "sarcoma", "tumor", "tumour"],
}

#: Separates title and abstract in a chunk.
CHUNK_SEPARATOR = "\n\n"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


#: Letters that have a capital of one letter, and those: in Unicode's simple case mapping no text changes its length.
_SMALL, _CAPITAL = map("".join, zip(*[(chr(i), u) for i in range(0x110000) if (u := {"ß": "ẞ"}.get(chr(i)) or next((c for c in (chr(i).upper(), chr(i).title()) if len(c) == 1), chr(i))) != chr(i)]))


def upper(text: Column) -> Column:
    """Capitals letter by letter, as DuckDB's upper has them: ``F.upper`` makes two letters of ß and of ligatures."""
    return F.translate(text, _SMALL, _CAPITAL)


def title_fingerprint(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def chunk(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit(CHUNK_SEPARATOR), abstract)


def terms(text: Column) -> Column:
    """Lexical analysis: ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct terms that are no stopwords."""
    return F.array_except(terms(text), F.array(*map(F.lit, STOPWORDS)))


def sentences(text: Column) -> Column:
    """Cut after a full stop, question or exclamation mark that white space follows; blank pieces go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def first_citation(sentence: Column, passages: Column) -> Column:
    """The passage that the first marker ``[n]`` names; null without one or beyond the passages."""
    n = F.regexp_extract(sentence, r"\[(\d+)\]", 1).try_cast("int")
    return F.when((n >= 1) & (n <= F.size(passages)), F.try_element_at(passages, F.greatest(n, F.lit(1))))


def citations(text: Column, passages: Column) -> Column:
    """Numbers of all markers within the passages, distinct, by first use."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= F.size(passages))))


def year(year_text: Column, free_text: Column) -> Column:
    """A numeric year, else the first four digits that stand alone in the free text, else null."""
    own = F.trim(year_text)
    other = F.regexp_extract(free_text, r"\b(\d{4})\b", 1)
    return F.coalesce(F.when(own.rlike("^[0-9]+$"), own.try_cast("int")), F.nullif(other, F.lit("")).try_cast("int"))


def is_language(tags: Column, tag: str = "eng") -> Column:
    """No language tags at all, or ``tag`` among them."""
    return (F.size(tags) == 0) | F.array_contains(tags, tag)


def domains(headings: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Topics of which some keyword is part of some heading, in alphabetic order."""
    found = []
    for domain, words_ in sorted((keywords or DOMAIN_KEYWORDS).items()):
        pattern = "|".join(words_)
        hit = F.exists(headings, lambda h: F.lower(h).rlike(pattern))  # noqa: B023  evaluated at once
        found.append(F.when(hit, F.lit(domain)))
    return F.array_compact(F.array(*found))


def hash_bucket(salt: str, key: Column, buckets: int = 100) -> Column:
    """sha256(salt:key) as a whole number modulo ``buckets``, by Horner's rule over its eight 32-bit words."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), key), 256)
    word = lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: (a * (2**32 % buckets) + word(i)) % buckets)


# Inference labels as they are written, and their numbers.
NLI_LABELS = {"contradiction": 2, "contrasting": 2, "entailment": 0, "neutral": 1, "reasoning": 0}


def nli_label(label: Column) -> Column:
    """The number of an inference label; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in NLI_LABELS.items() for x in kv]), F.lower(F.trim(label)))


def pad(ids: Column, width: Column | int, pad_id: int = 0) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), width)), F.lit(1), width)
