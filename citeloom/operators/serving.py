"""What a service sends, as tables: a JSON value for each question, so that a file of questions is answered like one.

Query ids are unique. Lists in a value are as long as the passages or sentences that were asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

from .evaluation import latency

# Fixed values.
GROUNDED, ABSTAINED = "GROUNDED", "ABSTAIN"
DISCLAIMER = "Research literature assistant. Not medical advice."


def _json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _in_order(order: str, *fields: Column | str) -> Column:
    """The structs of a group by a number."""
    rows = F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("item"))))
    return F.transform(rows, lambda r: r["item"])


def cited(made: DataFrame) -> DataFrame:
    """(query_id, n, pmid, source, sentence) of written answers (query_id, text, passages), as ``answers.extract`` gives them.

    A sentence counts for its first marker, which is taken out of it; pmid is null where the passages have no such number.
    """
    each = made.select("query_id", "passages", F.posexplode(X.sentences(F.col("text"))).alias("at", "line"))
    number = F.regexp_extract("line", r"\[(\d+)\]", 1).try_cast("int")
    return each.select("query_id", (F.col("at") + 1).alias("n"), X.first_citation(F.col("line"), F.col("passages")).alias("pmid"), number.alias("source"), F.regexp_replace("line", r"\s*\[\d+\]", "").alias("sentence"))


def answer_payloads(queries: DataFrame, found: DataFrame, hits: DataFrame, docs: DataFrame, *, nearest: int = 3) -> DataFrame:
    """(query_id, abstained, json) of each question.

    An answer, the rows of ``found`` (query_id, n, pmid, source, sentence), comes with its numbered sources; a question without one has
    its nearest documents by rank. Titles of documents that aren't there are null. Cited and nearest documents are looked up in one join.
    """
    sentences = found.groupBy("query_id").agg(_in_order("n", F.col("sentence").alias("text"), "pmid", F.col("source").alias("citation")).alias("sentences"))
    sources = found.filter("pmid IS NOT NULL").select("query_id", F.lit(True).alias("used"), F.col("source").cast("long").alias("at"), "pmid").distinct()
    near = hits.filter(F.col("rank") <= nearest).select("query_id", F.lit(False).alias("used"), F.col("rank").cast("long").alias("at"), "pmid")
    named = sources.unionByName(near).join(docs.select("pmid", "title"), "pmid", "left")
    listed = named.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("used"), F.struct(F.col("at").alias("citation"), "pmid", "title")))).alias("sources"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("used"), F.struct("at", "pmid", "title")))), lambda r: F.struct(r["pmid"].alias("pmid"), r["title"].alias("title"))).alias("nearest"),
    )
    rows = queries.select("query_id", "question").join(sentences, "query_id", "left").join(listed, "query_id", "left")
    silent = F.col("sentences").isNull()
    none = F.array().cast("array<struct<pmid:string,title:string>>")
    head = lambda abstained: [F.col("question").alias("query"), F.lit(abstained).alias("abstained"), F.lit(ABSTAINED if abstained else GROUNDED).alias("confidence")]
    end = F.lit(DISCLAIMER).alias("disclaimer")
    said = F.when(silent, _json(*head(True), F.coalesce("nearest", none).alias("nearest"), end)).otherwise(_json(*head(False), "sentences", "sources", end))
    return rows.select("query_id", silent.alias("abstained"), said.alias("json"))


def passage_payloads(queries: DataFrame, hits: DataFrame, docs: DataFrame, *, k: int = 5) -> DataFrame:
    """(query_id, json): the question and its first ``k`` passages, with score and title; an empty list without hits."""
    top = hits.filter(F.col("rank") <= k).join(docs.select("pmid", "title"), "pmid", "left")
    lists = top.groupBy("query_id").agg(_in_order("rank", "pmid", "score", "title").alias("passages"))
    rows = queries.select("query_id", "question").join(lists, "query_id", "left")
    none = F.array().cast("array<struct<pmid:string,score:double,title:string>>")
    return rows.select("query_id", _json(F.col("question").alias("query"), F.coalesce("passages", none).alias("passages")).alias("json"))


def events(queries: DataFrame, hits: DataFrame, payloads: DataFrame) -> DataFrame:
    """(query_id, place, event, data): what is streamed of each question, in order: its hits, its payload, and that it is done."""
    lists = hits.groupBy("query_id").agg(_in_order("rank", "pmid", "score").alias("found"))
    none = F.array().cast("array<struct<pmid:string,score:double>>")
    rows = queries.select("query_id").join(lists, "query_id", "left").join(payloads.select("query_id", "json"), "query_id", "left")
    steps = F.array(*[F.struct(F.lit(name).alias("event"), data.alias("data")) for name, data in (("retrieval", F.to_json(F.coalesce("found", none))), ("answer", F.col("json")), ("done", F.lit("{}")))])
    return rows.select("query_id", F.posexplode(steps).alias("place", "e")).select("query_id", "place", "e.event", "e.data")


def server_sent(event: Column, data: Column) -> Column:
    """An event in the text form of server-sent events."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def service_metrics(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """One row json: requests(endpoint) counted by endpoint, and p50, p95 and count of samples(stage, ms). Endpoints and stages are names of a program, hence few."""
    entries = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    counted = requests.groupBy("endpoint").agg(F.count("*").alias("n")).agg(entries("endpoint", "n").alias("counters"))
    timed = latency(samples).agg(entries("stage", F.struct("p50", "p95", "count")).alias("latency_ms"))
    return counted.crossJoin(timed).select(_json("counters", "latency_ms").alias("json"))  # single rows


def shown(payload: dict) -> str:
    """A payload as text: badge, cited sentences, sources and disclaimer; or the abstention and what came nearest."""
    title = lambda p: f"{p['pmid']} {p['title'] or ''}".rstrip()
    if payload["abstained"]:
        return "\n".join([ABSTAINED, *[f"nearest: {title(p)}" for p in payload["nearest"]]])
    lines = []
    for s in payload["sentences"]:
        body = s["text"].rstrip(".!?")
        lines.append(f"{body} [{s['citation']}]{s['text'][len(body):] or '.'}")
    return "\n".join([GROUNDED, " ".join(lines), *[f"[{p['citation']}] {title(p)}" for p in payload["sources"]], payload["disclaimer"]])
