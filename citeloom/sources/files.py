"""Readers and writers of the file formats around the engine. Lines keep their order as ``seq``."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators.ranking import first_rows

EVAL_SET = "name string, queries array<struct<query_id: string, question: string, relevant_pmids: array<string>>>"
QA = "map<string, struct<QUESTION: string, CONTEXTS: array<string>, final_decision: string>>"


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(seq, value): lines in the order of the files' names and of their own."""
    read = spark.read.text(path if isinstance(path, str) else list(path))
    return read.select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("seq"), "value")


def triples(rows: DataFrame, max_examples: int | None = None) -> DataFrame:
    """(seq, query, positive, negative) of tab-separated lines; those with an empty or missing field go, the cap counts valid ones."""
    part = F.split("value", "\t")
    found = rows.filter(F.size(part) >= 3).select("seq", *[part[i].alias(n) for i, n in enumerate(("query", "positive", "negative"))])
    return first_rows(found.filter((F.col("query") != "") & (F.col("positive") != "") & (F.col("negative") != "")), "seq", max_examples)


def pairs(rows: DataFrame) -> DataFrame:
    """(seq, anchor, positive): cut at the first tab, stripped, neither empty."""
    part = F.split("value", "\t", 2)
    found = rows.filter(F.size(part) == 2).select("seq", X.strip(part[0]).alias("anchor"), X.strip(part[1]).alias("positive"))
    return found.filter((F.col("anchor") != "") & (F.col("positive") != ""))


def general_lines(rows: DataFrame) -> DataFrame:
    """(seq, text): lines stripped, without blank ones; what ``word_budget`` and ``mix`` take."""
    return rows.select("seq", X.strip(F.col("value")).alias("text")).filter("text <> ''")


def inference(rows: DataFrame, *, premise: str = "sentence1", hypothesis: str = "sentence2", label: str = "gold_label", max_examples: int | None = None) -> DataFrame:
    """(seq, premise, hypothesis, label) of JSON lines; unknown labels and empty sides go."""
    field = lambda name: F.get_json_object("value", f"$.{name}")
    found = rows.select("seq", field(premise).alias("premise"), field(hypothesis).alias("hypothesis"), X.nli_label(field(label)).alias("label"))
    return first_rows(found.filter((F.col("premise") != "") & (F.col("hypothesis") != "") & F.col("label").isNotNull()), "seq", max_examples)


def qa_entries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, contexts, decision) of a JSON object keyed by id."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", QA)).alias("query_id", "e"))
    return entries.select("query_id", F.col("e.QUESTION").alias("question"), F.col("e.CONTEXTS").alias("contexts"), F.col("e.final_decision").alias("decision"))


def qa_pairs(entries: DataFrame, max_examples: int | None = None) -> DataFrame:
    """(query_id, anchor, positive): question, and contexts joined by spaces; both non-empty after stripping."""
    found = entries.select("query_id", X.strip(F.col("question")).alias("anchor"), X.strip(F.array_join("contexts", " ")).alias("positive"))
    return first_rows(found.filter((F.col("anchor") != "") & (F.col("positive") != "")), "query_id", max_examples)


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, relevant_pmids) of an evaluation set."""
    return spark.read.json(path, schema=EVAL_SET, multiLine=True).select(F.inline("queries"))


def canonical(name: str, queries: DataFrame) -> str:
    """The canonical JSON of an evaluation set, which is small: sorted keys and ids, indented, with a newline at its end."""
    rows = [{"query_id": r["query_id"], "question": r["question"], "relevant_pmids": sorted(r["relevant_pmids"])} for r in queries.orderBy("query_id").collect()]
    return json.dumps({"name": name, "queries": rows}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def frozen_eval_set(spark: SparkSession, path: str, sums: str) -> DataFrame:
    """The evaluation set of ``path``, whose canonical JSON must have the SHA-256 that the JSON object of ``sums`` gives for its file's name; else ValueError."""
    name = spark.read.json(path, schema=EVAL_SET, multiLine=True).first()["name"]
    queries = eval_set(spark, path)
    expected = json.loads(spark.read.text(sums, wholetext=True).first()["value"])
    found = hashlib.sha256(canonical(name, queries).encode()).hexdigest()
    file = path.rstrip("/").rsplit("/", 1)[-1]
    if expected.get(file, expected.get(name)) != found:
        raise ValueError(f"{file} isn't the frozen evaluation set: its checksum is {found}")
    return queries


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """``value`` as JSON of sorted keys in one file of any store that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True) + "\n").encode()))
    finally:
        out.close()


def track(spark: SparkSession, path: str, run: str, metrics: dict[str, float], params: dict[str, object] | None = None) -> None:
    """Append a run's metrics to a table of runs: (run, at, params, metric, value), a row for each metric."""
    rows = spark.createDataFrame([(run, {k: str(v) for k, v in (params or {}).items()}, m, float(v)) for m, v in metrics.items()], "run string, params map<string,string>, metric string, value double")
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def writable_pairs(rows: DataFrame) -> DataFrame:
    """Lines of pairs(anchor, positive) without tabs or line ends in either."""
    return rows.filter(~F.col("anchor").rlike("[\t\r\n]") & ~F.col("positive").rlike("[\t\r\n]")).select(F.concat_ws("\t", "anchor", "positive").alias("value"))


def write_pairs(rows: DataFrame, path: str) -> int:
    out = writable_pairs(rows)
    out.write.mode("overwrite").text(path)
    return rows.sparkSession.read.text(path).count()


def md5_of(text: Column) -> Column:
    """The first run of 32 hexadecimal digits, in lower case; null without any."""
    return F.nullif(F.lower(F.regexp_extract(text, "([a-fA-F0-9]{32})", 1)), F.lit(""))


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, expected, actual, ok) of the files of a folder that have a companion ``.md5``."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    sums = files.filter(F.col("file").endswith(".md5")).select(F.regexp_replace("file", r"\.md5$", "").alias("file"), md5_of(F.col("content").cast("string")).alias("expected"))
    return files.join(sums, "file").select("file", "expected", F.md5("content").alias("actual")).withColumn("ok", F.col("expected") == F.col("actual"))
