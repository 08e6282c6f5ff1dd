"""Queries of the store, text, corpus, split and training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import corpus, evaluation, serving, training, vocabulary
from citeloom.operators.storage import scratch
from citeloom.sources import files
from citeloom.sources.store import KeyedStore
from citeloom.sources.tables import dialogue, documents, questions, table

from .registry import content_sql, query, sentences_sql, with_parts, words_sql

# Topics by words of product names: the driver's tables have no subject headings.
COLOURS = {"earthen": ["brown", "chocolate", "sienna", "tan", "olive"], "green": ["green", "lime", "forest"], "marine": ["blue", "aqua", "navy", "sea"]}

_P = with_parts


@query(_P("docs") + "SELECT pmid, title, journal FROM docs ORDER BY pmid")
def store_scan(s, d):
    return documents(s, d).orderBy("pmid").select("pmid", "title", "journal")


@query(_P("docs") + "SELECT pmid, title, abstract FROM docs WHERE pmid = '42'")
def store_get(s, d):
    return documents(s, d).filter("pmid = '42'").select("pmid", "title", "abstract")


@query("SELECT p.pmid, EXISTS (SELECT 1 FROM documents WHERE CAST(doc_id AS VARCHAR) = p.pmid) AS present FROM (VALUES ('0'), ('42'), ('-1'), ('none')) p(pmid)")
def store_contains(s, d):
    asked = s.createDataFrame([("0",), ("42",), ("-1",), ("none",)], "pmid string")
    held = documents(s, d).select("pmid").join(F.broadcast(asked), "pmid", "left_semi").distinct().withColumn("present", F.lit(True))
    return asked.join(held, "pmid", "left").select("pmid", F.coalesce("present", F.lit(False)).alias("present"))


@query("SELECT count(*) AS n FROM documents")
def store_count(s, d):
    return table(s, d, "documents").agg(F.count("*").alias("n"))


@query(_P("docs") + "SELECT pmid, CASE WHEN lang = 'en' THEN upper(title) ELSE title END AS title FROM docs UNION ALL SELECT 'new', 'added'")
def store_upsert(s, d):
    old = documents(s, d).select("pmid", "title", "lang", "seq")
    new = old.filter("lang = 'en'").withColumn("title", X.upper(F.col("title"))).drop("lang").unionByName(s.createDataFrame([("new", "first", 1), ("new", "added", 2)], "pmid string, title string, seq long"))
    return corpus.upsert(old.drop("lang"), new).select("pmid", "title")


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(s, d):
    return table(s, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang = 'en'")
def lang_filter(s, d):
    tags = F.array_compact(F.array("lang"))
    return table(s, d, "documents").filter(X.is_language(tags, "en")).select("doc_id", "lang")


@query(_P("docs") + "SELECT pmid FROM docs WHERE pmid <> '' AND title <> '' AND abstract <> '' AND lang = 'en' AND contains(text, chr(10))")
def valid_filter(s, d):
    rows = documents(s, d, F.contains("text", F.lit("\n"))).filter("pmid <> '' AND title <> '' AND abstract <> ''")
    return rows.filter(X.is_language(F.array_compact(F.array("lang")), "en")).select("pmid")


@query(_P("docs") + "SELECT pmid, md5(title || chr(10) || chr(10) || abstract) AS chunk_md5, CAST(length(title || chr(10) || chr(10) || abstract) AS BIGINT) AS n FROM docs")
def chunk_text(s, d):
    c = X.chunk(F.col("title"), F.col("abstract"))
    return documents(s, d).select("pmid", F.md5(c).alias("chunk_md5"), F.length(c).cast("long").alias("n"))


@query(_P("docs") + "SELECT pmid, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS fingerprint FROM docs")
def title_fp(s, d):
    return documents(s, d).select("pmid", X.title_fingerprint(F.col("title")).alias("fingerprint"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_terms, md5(list_aggregate(regexp_extract_all(lower(text), '[a-z0-9]+'), 'string_agg', ' ')) AS terms_md5 FROM documents WHERE regexp_matches(lower(text), '[a-z0-9]')")
def tokenize(s, d):
    t = X.terms(F.col("text"))
    return table(s, d, "documents").filter(F.size(t) > 0).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("terms_md5"))


@query(f"SELECT item_id, array_to_string(list_sort({content_sql('text')}), ' ') AS terms FROM benchmark")
def content_terms(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.content_terms(F.col("text"))), " ").alias("terms"))


@query(_P("docs") + f"SELECT pmid, i - 1 AS at, ss[i] AS sentence FROM (SELECT pmid, {sentences_sql('abstract')} AS ss FROM docs), range(1, 1000000) r(i) WHERE i <= len(ss)")
def sentences(s, d):
    return documents(s, d).select("pmid", F.posexplode(X.sentences(F.col("abstract"))).alias("at", "sentence")).withColumn("at", F.col("at").cast("long"))


@query(
    _P("dialog")
    + """, t AS (SELECT conv_id, turn, question || ' [' || CAST(turn % 4 AS VARCHAR) || ']. So [2] and [' || CAST(turn % 3 AS VARCHAR) || '].' AS said FROM dialog),
    c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(said, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)) AS ns FROM t)
    SELECT conv_id, turn, CASE WHEN ns[1] BETWEEN 1 AND 3 THEN ['a','b','c'][ns[1]] END AS first_cited, array_to_string(list_sort(list_distinct(list_filter(ns, lambda n: n BETWEEN 1 AND 3))), ',') AS cited FROM c"""
)
def citation_parse(s, d):
    said = F.concat("question", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("]. So [2] and ["), (F.col("turn") % 3).cast("string"), F.lit("]."))
    passages = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return dialogue(s, d).select("conv_id", "turn", X.first_citation(said, passages).alias("first_cited"), F.array_join(F.array_sort(X.citations(said, passages)).cast("array<string>"), ",").alias("cited"))


@query(_P("dialog") + f"SELECT conv_id, turn, CAST(len(list_intersect({content_sql('question')}, {content_sql('answer')})) AS BIGINT) AS overlap FROM dialog")
def overlap(s, d):
    both = F.array_intersect(X.content_terms(F.col("question")), X.content_terms(F.col("answer")))
    return dialogue(s, d).select("conv_id", "turn", F.size(both).cast("long").alias("overlap"))


_YEARS = """y AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE strftime(o_orderdate, '%Y') END AS yt,
    CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'Issued ' || strftime(o_orderdate, '%Y-%m-%d') END AS mt, o_orderpriority FROM orders),
    z AS (SELECT o_orderkey, coalesce(CAST(CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE yt END AS INTEGER), TRY_CAST(nullif(regexp_extract(mt, '\\b(\\d{4})\\b', 1), '') AS INTEGER)) AS year FROM y WHERE o_orderpriority <> '4-NOT SPECIFIED'
        UNION ALL SELECT o_orderkey, NULL FROM y WHERE o_orderpriority = '4-NOT SPECIFIED')"""


def _years(s, d):
    """Orders with years as text, as free text, as a word that is none, or not at all."""
    date, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    year_text = F.when(kind == "1-URGENT", None).when(kind == "3-MEDIUM", F.lit("spring")).when(kind == "4-NOT SPECIFIED", None).otherwise(F.date_format(date, "yyyy"))
    free = F.when(kind.isin("2-HIGH", "4-NOT SPECIFIED"), None).otherwise(F.concat(F.lit("Issued "), F.date_format(date, "yyyy-MM-dd")))
    return table(s, d, "orders").select("o_orderkey", X.year(year_text, free).alias("year"))


@query(f"WITH {_YEARS} SELECT o_orderkey, year FROM z")
def year_extract(s, d):
    return _years(s, d)


@query(f"WITH {_YEARS} SELECT year, count(*) AS n FROM z GROUP BY year")
def stats_years(s, d):
    return corpus.year_histogram(_years(s, d))


@query(_P("docs") + ", r AS (SELECT pmid, title, row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY seq) AS n FROM docs) SELECT pmid, title FROM r WHERE n = 1")
def dedup_greedy(s, d):
    return corpus.deduplicate(documents(s, d)).select("pmid", "title")


_TWO_KEYS = """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS seq, CAST(doc_id % 397 AS VARCHAR) AS pmid, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS fp FROM documents),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS fs, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS pmid
    UNION ALL SELECT r.i, CASE WHEN ok THEN list_append(ps, r.pmid) ELSE ps END, CASE WHEN ok THEN list_append(fs, fp) ELSE fs END, CASE WHEN ok THEN r.seq END, r.pmid
    FROM (SELECT g.ps, g.fs, r.*, NOT list_contains(g.ps, r.pmid) AND NOT list_contains(g.fs, r.fp) AS ok FROM g JOIN r ON r.i = g.i + 1) r)
    SELECT pmid, seq FROM g WHERE seq IS NOT NULL"""


@query(_TWO_KEYS)
def dedup_two_keys(s, d):
    """Greedy de-duplication where both keys collide: rows go round by round, and by recursion, one after another, in the SQL."""
    return corpus.deduplicate(documents(s, d).withColumn("pmid", (F.col("seq") % 397).cast("string"))).select("pmid", "seq")


_DOMAINS = "p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS hs FROM part), f AS (SELECT p_partkey, list_filter([" + ", ".join(f"CASE WHEN len(list_filter(hs, lambda h: regexp_matches(h, '{'|'.join(ws)}'))) > 0 THEN '{n}' END" for n, ws in sorted(COLOURS.items())) + "], lambda x: x IS NOT NULL) AS ds FROM p)"


def _headed(s, d):
    return table(s, d, "part").select("p_partkey", X.domains(F.split(F.lower("p_name"), " "), COLOURS).alias("ds"))


@query(f"WITH {_DOMAINS} SELECT p_partkey, array_to_string(ds, ',') AS domains FROM f")
def domain_classify(s, d):
    return _headed(s, d).select("p_partkey", F.array_join("ds", ",").alias("domains"))


@query(f"WITH {_DOMAINS} SELECT p_partkey FROM f WHERE len(ds) > 0")
def domain_filter(s, d):
    return _headed(s, d).filter(F.size("ds") > 0).select("p_partkey")


@query(f"WITH {_DOMAINS}, e AS (SELECT unnest(CASE WHEN len(ds) = 0 THEN ['out_of_scope'] ELSE ds END) AS domain FROM f) SELECT v.domain, count(e.domain) AS n FROM (VALUES ('earthen'), ('green'), ('marine'), ('out_of_scope')) v(domain) LEFT JOIN e ON v.domain = e.domain GROUP BY v.domain")
def stats_domains(s, d):
    return corpus.scope_counts(_headed(s, d), F.col("ds"), list(COLOURS))


@query(_P("docs") + ", u AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY seq) AS n FROM docs) SELECT count(*) AS parsed, count(*) FILTER (n = 1) AS unique_docs, count(*) FILTER (n = 1 AND lang = 'en') AS in_domain FROM u")
def ingest_summary(s, d):
    rows = documents(s, d)
    unique = corpus.deduplicate(rows)
    in_domain = X.is_language(F.array("lang"), "en")
    counted = unique.agg(F.count("*").alias("unique_docs"), F.coalesce(F.sum(in_domain.cast("long")), F.lit(0)).alias("in_domain"))
    return rows.agg(F.count("*").alias("parsed")).crossJoin(counted)


@query(_P("docs") + f"SELECT count(*) AS n_docs, CAST(sum(len({words_sql('abstract')})) AS BIGINT) AS total_words, avg(len({words_sql('abstract')})) AS mean_words FROM docs")
def stats_words(s, d):
    return corpus.word_stats(documents(s, d))


@query(_P("docs") + "SELECT journal, n FROM (SELECT journal, count(*) AS n, min(pmid) AS p FROM docs WHERE journal IS NOT NULL GROUP BY journal) ORDER BY n DESC, p LIMIT 10")
def stats_journals(s, d):
    return corpus.top_journals(documents(s, d), 10)


@query(
    _P("bench")
    + ", h AS (SELECT query_id, sha256('split:' || query_id) AS x FROM bench), b AS (SELECT query_id, list_reduce([0] || list_transform(range(0, 8), lambda i: CAST(('0x' || substr(x, CAST(i * 8 + 1 AS INTEGER), 8)) AS BIGINT)), lambda a, w: (a * 96 + w) % 100) AS bucket FROM h) SELECT query_id, CAST(bucket AS BIGINT) AS bucket, CASE WHEN bucket < 50 THEN 'dev' ELSE 'test' END AS part FROM b"
)
def hash_split(s, d):
    return corpus.split(questions(s, d), "split").select("query_id", "bucket", "part")


@query("SELECT count(*) AS n, sha256(string_agg(CAST(item_id AS VARCHAR) || chr(9) || text, chr(10) ORDER BY item_id)) AS checksum FROM benchmark")
def split_checksum(s, d):
    # an evaluation set is frozen and small by definition; its canonical text is one value
    rows = F.array_sort(F.collect_list(F.struct("item_id", F.concat(F.col("item_id").cast("string"), F.lit("\t"), "text").alias("line"))))
    return table(s, d, "benchmark").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("checksum"))


@query(_P("docs") + "SELECT pmid, CASE WHEN lang = 'en' THEN upper(title) ELSE title END AS title, lang FROM docs WHERE lang <> 'de' UNION ALL SELECT 'new', 'added', 'xx'")
def store_merge(s, d):
    """A stored table after an update of some rows, the removal of others, compaction and one more row."""
    docs = documents(s, d).select("pmid", "title", "lang")
    store = KeyedStore(s, scratch(s, "store"), key="pmid")
    store.upsert(docs)
    store.upsert(docs.filter("lang = 'en'").withColumn("title", X.upper(F.col("title"))))
    store.remove(docs.filter("lang = 'de'"))
    store.compact()
    store.upsert(s.createDataFrame([("new", "added", "xx")], "pmid string, title string, lang string"))
    return store.table()


@query(_P("docs bench qrels") + "SELECT query_id, CAST(count(*) AS BIGINT) AS n_relevant, string_agg(pmid, ',' ORDER BY pmid) AS relevant FROM qrels GROUP BY query_id")
def qrels_build(s, d):
    found = corpus.passages_within(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "text"), questions(s, d))
    return found.groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.array_join(F.array_sort(F.collect_list("pmid")), ",").alias("relevant"))


@query("SELECT item_id, printf('pubmed25n%04d.xml.gz', item_id) AS file, md5(text) AS expected, true AS ok FROM benchmark")
def md5_verify(s, d):
    line = F.concat(F.lit("MD5(file)= "), F.upper(F.md5("text")))
    rows = table(s, d, "benchmark").select("item_id", F.format_string("pubmed25n%04d.xml.gz", "item_id").alias("file"), files.md5_of(line).alias("expected"), F.md5("text").alias("actual"))
    return rows.select("item_id", "file", "expected", (F.col("expected") == F.col("actual")).alias("ok"))


_TRIPLES = "tr AS (SELECT conv_id * 1000 + turn AS seq, question AS query, answer AS positive, lead(answer, 1, '') OVER (ORDER BY conv_id, turn) AS negative FROM dialog)"


def _triples(s, d):
    """Tab-separated lines of question, answer, and the answer that comes next in another place."""
    from pyspark.sql import Window

    rows = dialogue(s, d).withColumn("block", F.floor(F.col("conv_id") / 1000))
    nxt = F.lead("answer").over(Window.partitionBy("block").orderBy("conv_id", "turn"))
    heads = rows.groupBy("block").agg(F.min_by("answer", F.struct("conv_id", "turn")).alias("head"))
    after = heads.select("block", F.lead("head").over(Window.orderBy("block")).alias("next_head"))  # a row for each block
    lined = rows.withColumn("nxt", nxt).join(after, "block").withColumn("negative", F.coalesce("nxt", "next_head", F.lit("")))
    return lined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat_ws("\t", "question", "answer", "negative").alias("value"))


_VALID = " WHERE query <> '' AND positive <> '' AND negative <> '' AND NOT contains(query || positive || negative, chr(9))"


@query(_P("dialog", _TRIPLES) + "SELECT query, positive, min(seq) AS seq FROM tr" + _VALID + " GROUP BY query, positive")
def msmarco_pairs(s, d):
    return training.distinct_pairs(files.triples(_triples(s, d)))


@query(_P("dialog", _TRIPLES) + "SELECT query, positive AS text, 1 AS label FROM tr" + _VALID + " UNION ALL SELECT query, negative, 0 FROM tr" + _VALID)
def triples_expand(s, d):
    return training.labelled_pairs(files.triples(_triples(s, d)))


@query(_P("dialog", _TRIPLES) + "SELECT query, positive AS text, 1 AS label FROM (SELECT DISTINCT query, positive FROM tr" + _VALID + ") UNION ALL SELECT query, negative, 0 FROM tr" + _VALID)
def triples_array(s, d):
    """Rows of a positive with all its negatives, taken apart again."""
    several = files.triples(_triples(s, d)).groupBy("query", "positive").agg(F.collect_list("negative").alias("negative"))
    return training.labelled_pairs(several)


@query(_P("dialog") + "SELECT text FROM (SELECT question AS text FROM dialog UNION SELECT answer FROM dialog UNION SELECT text FROM documents) WHERE text <> ''")
def pretraining_texts(s, d):
    """The different texts of questions, answers and documents."""
    turns = dialogue(s, d)
    return training.distinct_texts(turns.select(F.col("question").alias("text")), turns.select(F.col("answer").alias("text")), table(s, d, "documents"))


@query(_P("dialog") + "SELECT conv_id, turn, question AS premise, answer AS hypothesis, turn % 3 AS label FROM dialog WHERE question <> '' AND answer <> '' AND turn % 4 <> 2")
def nli_load(s, d):
    forms = F.element_at(F.array(F.lit("entailment"), F.lit("neutral"), F.lit("contradiction")), (F.col("turn") % 3 + 1).cast("int"))
    label = F.when(F.col("turn") % 4 == 2, F.lit("-")).otherwise(forms)
    rows = dialogue(s, d).select(F.struct("conv_id", "turn").alias("seq"), F.to_json(F.struct(F.col("question").alias("sentence1"), F.col("answer").alias("sentence2"), label.alias("gold_label"))).alias("value"))
    return files.inference(rows).select("seq.conv_id", "seq.turn", "premise", "hypothesis", F.col("label").cast("long").alias("label"))


@query(_P("dialog") + "SELECT CAST(conv_id AS VARCHAR) AS query_id, regexp_replace(arg_min(question, turn), '^\\s+|\\s+$', '', 'g') AS anchor, regexp_replace(string_agg(answer, ' ' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS positive FROM dialog GROUP BY conv_id")
def pqa_pairs(s, d):
    each = dialogue(s, d).groupBy("conv_id").agg(F.min_by("question", "turn").alias("question"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "answer"))), lambda a: a["answer"]).alias("contexts"))
    return files.qa_pairs(each.select(F.col("conv_id").cast("string").alias("query_id"), "question", "contexts")).select("query_id", "anchor", "positive")


@query(_P("docs") + "SELECT title || chr(9) || abstract AS value FROM docs WHERE NOT regexp_matches(title, '[\\t\\r\\n]') AND NOT regexp_matches(abstract, '[\\t\\r\\n]')")
def pairs_tsv(s, d):
    return files.writable_pairs(documents(s, d).select(F.col("title").alias("anchor"), F.col("abstract").alias("positive")))


@query(_P("docs") + "SELECT pmid, title AS anchor, abstract AS positive FROM docs WHERE title <> '' AND abstract <> ''")
def title_pairs(s, d):
    return training.title_pairs(documents(s, d))


@query(_P("docs") + f", w AS (SELECT pmid, {words_sql('abstract')} AS w FROM docs) SELECT pmid, array_to_string(w[1:len(w) // 2], ' ') AS anchor, array_to_string(w[len(w) // 2 + 1:], ' ') AS positive FROM w WHERE len(w) >= 8")
def ssl_pairs(s, d):
    return training.halves(documents(s, d))


@query(
    _P("bench")
    + ", t AS (SELECT query_id, list_transform(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w))[1:256] AS ids, CAST(query_id AS BIGINT) // 8 AS batch FROM bench), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS w FROM t) SELECT query_id, array_to_string(list_resize(ids, w, 0), ',') AS padded, array_to_string(list_resize(list_transform(ids, lambda x: 1), w, 0), ',') AS mask FROM m"
)
def pad_batch(s, d):
    rows = questions(s, d).select("query_id", F.transform(X.terms(F.col("question")), lambda w: F.length(w)).alias("ids"), F.floor(F.col("query_id").cast("long") / 8).alias("batch"))
    out = training.pad_batches(rows, batch="batch", ids="ids", max_length=256)
    return out.select("query_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("padded", "mask")])


@query(
    _P("docs")
    + f", g AS (SELECT seq, len({words_sql('abstract')}) AS n, lang FROM docs), b AS (SELECT sum(n) * (1 - 0.7) / 0.7 AS budget FROM g WHERE lang <> 'en'), r AS (SELECT seq, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE lang = 'en') SELECT 'domain' AS part, seq FROM g WHERE lang <> 'en' UNION ALL SELECT 'general', seq FROM r WHERE before < (SELECT budget FROM b)"
)
def token_mix(s, d):
    rows = documents(s, d).select("seq", F.col("abstract").alias("text"), "lang")
    return training.mix(rows.filter("lang <> 'en'").drop("lang"), rows.filter("lang = 'en'").drop("lang")).select("part", "seq")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word")
def bpe_wordcounts(s, d):
    return training.word_counts(table(s, d, "documents"))


@query(f"SELECT CAST(sum(len(regexp_extract_all(text, 'th|er|on|an|tion|en|de|.'))) AS BIGINT) AS tokens, CAST(sum(len({words_sql('text')})) AS BIGINT) AS words, sum(len(regexp_extract_all(text, 'th|er|on|an|tion|en|de|.'))) / sum(len({words_sql('text')})) AS fertility FROM documents WHERE len({words_sql('text')}) > 0")
def fertility(s, d):
    pieces = F.regexp_extract_all("text", F.lit("th|er|on|an|tion|en|de|."), F.lit(0))
    return training.fertility(table(s, d, "documents"), pieces)


@query("SELECT event_type AS stage, count(*) AS \"count\", list_sort(list(value))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def latency_pct(s, d):
    return evaluation.latency(table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("SELECT event_type AS endpoint, count(*) AS n FROM events GROUP BY event_type")
def req_counters(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("n"))


_PLACE = "list_sort(list(value))[CAST(least(count(*) - 1, floor({} * count(*))) AS BIGINT) + 1]"


@query(f"SELECT event_type AS name, count(*) AS n, {_PLACE.format(0.5)} AS p50, {_PLACE.format(0.95)} AS p95 FROM events GROUP BY event_type")
def service_metrics(s, d):
    """Counters and latencies as a service would report them, read back out of their JSON."""
    rows = table(s, d, "events").select(F.col("event_type").alias("endpoint"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    sent = serving.service_metrics(rows.select("endpoint"), rows.select("stage", "ms"))
    told = sent.select(F.from_json("json", "counters map<string,long>, latency_ms map<string,struct<p50:double,p95:double,count:long>>").alias("m"))
    each = told.select(F.explode("m.latency_ms").alias("name", "t"), "m.counters")
    return each.select("name", F.element_at("counters", F.col("name")).alias("n"), "t.p50", "t.p95")


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages")
def pages_scan(s, d):
    return table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("n"))


#: A small list of merges, for a sweep that SQL can follow.
_MERGES = [(b"t", b"h"), (b"th", b"e"), (b"o", b"n"), (b"a", b"n"), (b"an", b"d"), (b"e", b"r")]
_STEPS = ["x"]
for _i, (_a, _b) in enumerate(_MERGES):
    _glyph = {b"th": "chr(57344)", b"an": "chr(57347)"}
    _side = lambda s: _glyph.get(s, f"'{s.decode()}'")
    _STEPS.append(f"replace({_STEPS[-1]}, {_side(_a)} || {_side(_b)}, chr({57344 + _i}))")


@query(
    f"WITH w AS (SELECT {words_sql('text')} AS w FROM documents), t AS (SELECT array_to_string(w, ' ') AS x, len(w) AS n FROM w WHERE len(w) > 0), s AS ("
    + " UNION ALL ".join(f"SELECT {256 + i} AS size, CAST(sum(strlen(x) - (n - 1) - (length(x) - length({step}))) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS words FROM t" for i, step in enumerate(_STEPS))
    + ") SELECT CAST(size AS BIGINT) AS size, tokens, words, round(tokens / words, 6) AS fertility FROM s"
)
def vocabulary_sweep(s, d):
    """Fertility at each size of a small vocabulary."""
    found = vocabulary.sweep(table(s, d, "documents"), _MERGES, range(256, 257 + len(_MERGES)))
    return found.select("size", "tokens", "words", F.round("fertility", 6).alias("fertility"))


@query()
def vocabulary_sweep_full(s, d):
    """Fertility of a public tokenizer's merges at sizes up to its whole, each word with the space before it."""
    import public_tokenizers

    merges = vocabulary.merges_of(s, public_tokenizers.path("byte_bpe_50k.json"))
    return vocabulary.sweep(table(s, d, "documents"), merges, [256, 512, 1000, 2000, 4000, 8000, 16000, 32000, 256 + len(merges)], prefix=b" ")


@query("SELECT n_nationkey AS id, n_name AS piece FROM nation UNION ALL SELECT max(n_nationkey) + 1, '[MASK]' FROM nation")
def mask_token(s, d):
    """A vocabulary with a token added, twice, which is as once."""
    pieces = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("piece"))
    return vocabulary.with_token(vocabulary.with_token(pieces, "[MASK]"), "[MASK]")
