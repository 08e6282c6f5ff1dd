"""Command line: ingest article files, answer questions, train models, evaluate and study retrievers. ``python -m citeloom.cli --help``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import answers, bm25, corpus, evaluation, generation, learning, retrievers, serving, training, vectors, verification
from citeloom.operators.storage import settled
from citeloom.sources import articles, files, manifest
from citeloom.sources.store import DocumentStore


def _retriever_options(p: argparse.ArgumentParser, *, probes: str | None = None) -> None:
    p.add_argument("--retriever", default="bm25", choices=retrievers.KINDS)
    p.add_argument("--index", help="folder of saved indexes; they are made there if absent")
    p.add_argument("--ann", default="exact", choices=retrievers.ANN_KINDS)
    p.add_argument("--probes", type=int, nargs=probes, help="cells or shards that a query looks at; as many as a sample needs by default")
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--rerank-weight", type=float, default=0.0)
    p.add_argument("--k1", type=float, default=bm25.K1)
    p.add_argument("--b", type=float, default=bm25.B)
    p.add_argument("--embedder", help="folder of a trained encoder; hashed terms by default")


def _answer_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--passages", type=int, default=5)
    p.add_argument("--sentences", type=int, default=3)
    p.add_argument("--answerer", default="extractive", choices=("extractive", "generated"))
    p.add_argument("--verifier", help="folder of a trained verifier: a generated answer that it doesn't bear out gives way to an extracted one")


def _encode(args: argparse.Namespace, spark: SparkSession):
    return learning.Encoder.load(spark, args.embedder).encode if args.embedder else vectors.embed


def _retriever(args: argparse.Namespace, docs: DataFrame) -> retrievers.Retriever:
    return retrievers.build(args.retriever, docs, index=args.index, ann=args.ann, probes=args.probes, rerank=args.rerank, weight=args.rerank_weight, k1=args.k1, b=args.b, encode=_encode(args, docs.sparkSession))


def _answered(args: argparse.Namespace, asked: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and payloads of asked(query_id, question)."""
    hits = settled(_retriever(args, docs).search(asked, args.passages))
    found = answers.extract(asked, hits, docs, passages=args.passages, sentences=args.sentences).select("query_id", "n", "pmid", "source", "sentence")
    if args.answerer == "generated":
        made = settled(generation.spoken(generation.generate(asked, hits, docs, passages=args.passages, sentences=args.sentences)))
        if args.verifier:
            model = learning.Classifier.load(docs.sparkSession, args.verifier)
            checked = verification.verdicts(made, docs, lambda premise, hypothesis: model.label(learning.pair_features(premise, hypothesis)))
            made = settled(made.join(verification.report(made, checked).filter("grounded"), "query_id", "left_semi"))
            found = found.join(made, "query_id", "left_anti").unionByName(serving.cited(made))
        else:
            found = serving.cited(made)
    return hits, serving.answer_payloads(asked, found, hits, docs)


def _train(args: argparse.Namespace, docs: DataFrame) -> None:
    """Train on a store's documents, of which a fifth is held out, save the model and print a line for each epoch."""
    spark = docs.sparkSession
    held = F.pmod(F.xxhash64("pmid", F.lit(7)), F.lit(5)) == 0
    if args.model == "encoder":
        encoder, losses = learning.Encoder.untrained().train(training.halves(docs.filter(~held)), epochs=args.epochs, rate=args.rate or 0.01)
        encoder.save(spark, args.out)
        lines = [{"epoch": i, "loss": loss} for i, loss in enumerate(losses, 1)]
    else:
        fit = learning.train_verifier if args.model == "verifier" else learning.train_gate
        fitted = fit(docs, held_out=held, epochs=args.epochs, rate=args.rate or 0.3)
        fitted.model.save(spark, args.out)
        lines = [{"epoch": e, "loss": loss, "held_out_accuracy": right} for e, loss, right in fitted.history]
    for line in lines:
        print(json.dumps(line))


def _study(args: argparse.Namespace, docs: DataFrame, queries: DataFrame) -> None:
    """Recall and latency of a vector index by its probes, or the point of the risk-coverage curve nearest to a coverage."""
    if args.what == "ann":
        encode = _encode(args, docs.sparkSession)
        points = encode(docs.select("pmid", X.chunk(F.col("title"), F.col("abstract")).alias("text")))
        asked = encode(queries.select(F.col("query_id").alias("pmid"), F.col("question").alias("text"))).withColumnRenamed("pmid", "query_id")
        for row in retrievers.ann_curve(args.ann, settled(points), settled(asked), args.probes or [1, 2, 4, 8], path=args.index).collect():
            print(json.dumps(row.asDict()))
    else:
        qrels = queries.select("query_id", F.explode("relevant_pmids").alias("pmid"))
        records = answers.calibration_records(queries, settled(_retriever(args, docs).search(queries.select("query_id", "question"), 5)), qrels)
        print(json.dumps(answers.operating_point(answers.risk_coverage(records, "query_id"), args.target).first().asDict()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest", help="parse article files into a store")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--store", required=True)
    p.add_argument("--no-domain-filter", action="store_true")
    p = commands.add_parser("sync", help="ingest the files of a folder that weren't yet, or were corrupt")
    p.add_argument("folder")
    p.add_argument("--store", required=True)
    p.add_argument("--manifest", help="the table of files; beside the store by default")
    p.add_argument("--no-domain-filter", action="store_true")
    p = commands.add_parser("ask", help="answer a question with cited sentences, or abstain")
    p.add_argument("question")
    p.add_argument("--store", required=True)
    _retriever_options(p)
    _answer_options(p)
    p.add_argument("--json", action="store_true", help="print the payload")
    p.add_argument("--stream", action="store_true", help="print it as server-sent events")
    p = commands.add_parser("answer", help="answer a file of questions: JSON lines of query_id and question")
    p.add_argument("questions")
    p.add_argument("--store", required=True)
    p.add_argument("--out", required=True, help="folder for the table of payloads")
    _retriever_options(p)
    _answer_options(p)
    p = commands.add_parser("train", help="train a model on a store's documents")
    p.add_argument("model", choices=("encoder", "verifier", "gate"))
    p.add_argument("--store", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--epochs", type=int, default=5)
    p.add_argument("--rate", type=float)
    p = commands.add_parser("study", help="recall and latency of a vector index by its probes, or when to abstain")
    p.add_argument("what", choices=("ann", "calibration"))
    p.add_argument("split")
    p.add_argument("--store", required=True)
    _retriever_options(p, probes="+")
    p.add_argument("--target", type=float, default=0.8, help="the coverage to come near to")
    p = commands.add_parser("evaluate", help="metrics of a retriever on an evaluation set")
    p.add_argument("split")
    p.add_argument("--store", required=True)
    _retriever_options(p)
    p.add_argument("--checksums", help="JSON of SHA-256 by file name; another evaluation set than the frozen one is refused")
    p.add_argument("--out", help="file for the metrics")
    p.add_argument("--track", help="table of runs to append the metrics to")
    p.add_argument("--run", default="evaluate", help="the run's name there")
    p = commands.add_parser("report", help="statistics of a store")
    p.add_argument("--store", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("citeloom").getOrCreate()

    if args.command == "ingest":
        try:
            print(json.dumps(articles.ingest(spark, args.inputs, DocumentStore(spark, args.store), domain_filter=not args.no_domain_filter)))
        except (AnalysisException, ValueError) as e:
            print(f"no input: {e}"[:300], file=sys.stderr)
            return 1
        return 0
    store = DocumentStore(spark, args.store)
    if args.command == "sync":
        seen = manifest.Manifest(spark, args.manifest or args.store.rstrip("/") + ".files")
        print(json.dumps(manifest.ingest_folder(spark, args.folder, store, seen, domain_filter=not args.no_domain_filter)))
        return 0
    if not store.snapshot()["version"] and store.table().isEmpty():
        print(f"no store at {args.store}", file=sys.stderr)
        return 1
    docs = store.table()
    if args.command == "report":
        print(corpus.report(docs), end="")
    elif args.command == "train":
        _train(args, docs)
    elif args.command in ("ask", "answer"):
        one = args.command == "ask"
        asked = spark.createDataFrame([("q", args.question)], "query_id string, question string") if one else spark.read.schema("query_id string, question string").json(args.questions)
        try:
            hits, sent = _answered(args, asked, docs)
        except (AnalysisException, ValueError) as e:
            print(f"no such model or index: {e}"[:300], file=sys.stderr)
            return 1
        if not one:
            sent.write.mode("overwrite").parquet(args.out)
            n = spark.read.parquet(args.out).agg(F.count("*").alias("questions"), F.count_if("abstained").alias("abstained"))
            print(json.dumps(n.first().asDict()))
        elif args.stream:
            said = serving.events(asked, hits, settled(sent)).orderBy("place").select(serving.server_sent(F.col("event"), F.col("data")))
            print("".join(r[0] for r in said.collect()), end="")  # three rows
        else:
            payload = sent.first()["json"]
            print(payload if args.json else serving.shown(json.loads(payload)))
    else:
        try:
            queries = files.frozen_eval_set(spark, args.split, args.checksums) if getattr(args, "checksums", None) else files.eval_set(spark, args.split)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        if args.command == "study":
            _study(args, docs, queries)
            return 0
        qrels = queries.select("query_id", F.explode("relevant_pmids").alias("pmid"))
        hits = _retriever(args, docs).search(queries.select("query_id", "question"), 100)
        found = evaluation.metrics(hits, qrels).first().asDict()
        if args.out:
            files.write_json(spark, found, args.out)
        if args.track:
            files.track(spark, args.track, args.run, found, {k: v for k, v in vars(args).items() if v is not None})
        print(json.dumps(found, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
