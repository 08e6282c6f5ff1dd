"""Named queries over a folder of tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.functions.text import STOPWORDS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions of the SQL side.
_STOP = "'" + "','".join(STOPWORDS) + "'"
PARTS = {
    "docs": "docs AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS abstract, lang, source AS journal, doc_id AS seq, text FROM documents)",
    "bench": "bench AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS question FROM benchmark)",
    "qrels": "qrels AS (SELECT query_id, pmid FROM bench JOIN docs ON contains(docs.text, bench.question))",
    "vecs": "vecs AS (SELECT CAST(vec_id AS VARCHAR) AS pmid, vec_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)",
    "dialog": "dialog AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')",
    "post": "post AS (SELECT pmid, term, count(*) AS tf FROM (SELECT pmid, unnest(regexp_extract_all(lower(title || chr(10) || chr(10) || abstract), '[a-z0-9]+')) AS term FROM docs) GROUP BY ALL)",
    "dls": "dls AS (SELECT pmid, CAST(len(regexp_extract_all(lower(title || chr(10) || chr(10) || abstract), '[a-z0-9]+')) AS BIGINT) AS dl FROM docs)",
    "tot": "tot AS (SELECT count(*) AS n_docs, coalesce(avg(dl), 0) AS avgdl FROM dls)",
    "dfs": "dfs AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n_docs FROM tot) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)",
    "asked": "asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM bench))",
}


def bm25_sql(k: int, k1: float = 1.5, b: float = 0.75, name: str = "hits") -> str:
    return f"""{name}_s AS (
        SELECT query_id, pmid, sum(idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / (SELECT avgdl FROM tot)))) AS score
        FROM asked JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (pmid) GROUP BY query_id, pmid),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pmid) AS rank FROM {name}_s) WHERE rank <= {k})"""


def with_parts(names: str, *more: str) -> str:
    return "WITH " + ", ".join([PARTS[n] for n in names.split()] + list(more)) + " "


BM25_PARTS = "docs bench post dls tot dfs asked"


def content_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), lambda t: NOT list_contains([{_STOP}], t))"


def sentences_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
