"""Queries of trained models. Models are trained once a session, kept as versioned artifacts and read back; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import answers, bm25, evaluation, generation, learning, training, vectors, verification
from citeloom.operators.storage import built_once, settled
from citeloom.sources.tables import documents, questions, table

from .registry import query
from .search import _answers, _hits, _hits_alone, _index

_HASHED, _EPOCHS, _TERMS = 4096, 4, 1024


def _held_out(key: str) -> Column:
    """A fifth of the documents, which training never sees."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(5)) == 0


def _kept(spark: SparkSession, path: str, fitted: learning.Fitted) -> learning.Fitted:
    """``fitted`` as its artifact under ``path`` gives it."""
    fitted.model.save(spark, path)
    return learning.Fitted(learning.Classifier.load(spark, path), fitted.history)


def _examples(s, d) -> DataFrame:
    """What the verifier and the gate learn from."""
    docs = documents(s, d)
    return built_once(docs, "pair-examples", lambda path: learning.pair_examples(docs, held_out=_held_out("pmid")))


def _verifier(s, d) -> learning.Fitted:
    return built_once(documents(s, d), "verifier", lambda path: _kept(s, path, learning.fit_verifier(_examples(s, d), rate=0.3, epochs=_EPOCHS)))


def _gate(s, d) -> learning.Fitted:
    return built_once(documents(s, d), "gate", lambda path: _kept(s, path, learning.fit_gate(_examples(s, d), rate=0.3, epochs=_EPOCHS)))


def _judged(s, d) -> DataFrame:
    """Labelled texts in three classes, 0 good, 1 poor, 2 toxic, whose features are computed once and kept."""
    labels = table(s, d, "labels")

    def made(path: str) -> DataFrame:
        rows = labels.join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
        label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
        return settled(rows.select("doc_id", label.alias("label"), *learning.text_features(F.coalesce("text", F.lit("")), _TERMS)))

    return built_once(labels, "judged", made)


def _classes(s, d) -> learning.Fitted:
    labels = table(s, d, "labels")

    def made(path: str) -> learning.Fitted:
        rows = _judged(s, d)
        held = _held_out("doc_id")
        return _kept(s, path, learning.fit_classifier(rows.filter(~held), rows.filter(held), classes=3, dim=_TERMS, rate=0.1, epochs=_EPOCHS))

    return built_once(labels, "classes", made)


def _pairs(s, d) -> tuple[DataFrame, DataFrame]:
    """Halves of abstracts that belong together: those to learn from, and the held-out ones."""
    pairs = training.halves(documents(s, d))
    return pairs.filter(~_held_out("pmid")), pairs.filter(_held_out("pmid"))


def _encoder(s, d) -> tuple[learning.Encoder, list[float]]:
    docs = documents(s, d)

    def made(path: str) -> tuple[learning.Encoder, list[float]]:
        encoder, losses = learning.Encoder.untrained(_HASHED).train(_pairs(s, d)[0], epochs=_EPOCHS)
        encoder.save(s, path)
        return learning.Encoder.load(s, path), losses

    return built_once(docs, "encoder", made)


@query()
def contrastive_epochs(s, d):
    """Mean loss of each epoch of the contrastive training on halves of abstracts."""
    return s.createDataFrame(list(enumerate(_encoder(s, d)[1], 1)), "epoch int, loss double")


@query()
def contrastive_recall(s, d):
    """Share of held-out halves whose other half is among the five nearest of all held-out ones, before and after training."""
    held, encoders = _pairs(s, d)[1], {"untrained": learning.Encoder.untrained(_HASHED), "trained": _encoder(s, d)[0]}
    made = settled(held.select("pmid", *[e.vector(s, F.col(c)).alias(f"{name}_{c}") for name, e in encoders.items() for c in ("anchor", "positive")]))
    both = None
    for name in encoders:
        near = vectors.own_within(made.select("pmid", F.col(f"{name}_anchor").alias("asked"), F.col(f"{name}_positive").alias("vector")), 5)
        hits = made.select("pmid").join(near, "pmid", "left")
        row = hits.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.avg(F.col("rank").isNotNull().cast("int")).alias("recall_at_5"))
        both = row if both is None else both.unionByName(row)
    return both


@query()
def training_epochs(s, d):
    """Loss and held-out accuracy by epoch of the trained verifier, gate and answer classes."""
    models = {"verifier": _verifier(s, d), "gate": _gate(s, d), "classes": _classes(s, d)}
    return s.createDataFrame([(name, *h) for name, fitted in models.items() for h in fitted.history], "model string, epoch int, loss double, accuracy double")


@query()
def best_epoch_trained(s, d):
    """The epoch that each of these models keeps."""
    return evaluation.best_epoch(training_epochs(s, d).withColumnRenamed("model", "group"))


@query()
def accuracy_trained(s, d):
    """Accuracy of the trained answer classes on held-out labelled rows, beside that of the commonest label."""
    held = _judged(s, d).filter(_held_out("doc_id"))
    scored = _classes(s, d).model.probabilities(held).select(F.col("doc_id").alias("id"), learning.likeliest(F.col("probability")).cast("string").alias("predicted"))
    gold = held.select(F.col("doc_id").alias("id"), F.col("label").cast("string").alias("label"))
    most = evaluation.label_shares(gold).agg(F.max("majority").alias("majority"))
    return evaluation.accuracy(scored, gold).crossJoin(most)  # single rows


@query()
def answerability_trained(s, d):
    """Probability by the trained gate that the five best passages answer the question."""
    gate = _gate(s, d).model
    found = verification.answerability(questions(s, d), _hits(s, d), documents(s, d), scorer=lambda context, question: F.get(gate.scores(learning.pair_features(context, question)), F.lit(1)))
    return found.select("query_id", F.round("probability", 6).alias("probability"))


@query()
def verify_trained(s, d):
    """The citation report of extracted answers under the trained verifier."""
    model = _verifier(s, d).model
    found = settled(_answers(s, d, _hits_alone(s, d)))
    cited = answers.render(found).join(answers.sources(found), "query_id")
    docs = documents(s, d).join(found.select("pmid").distinct(), "pmid", "left_semi")  # the texts of others stay where they are
    return verification.report(cited, verification.verdicts(cited, docs, lambda premise, hypothesis: model.label(learning.pair_features(premise, hypothesis))))


@query()
def dense_trained_topk(s, d):
    """The ten nearest documents of each question under the trained encoder."""
    encoder = _encoder(s, d)[0]
    asked = encoder.encode(questions(s, d).select(F.col("query_id").alias("pmid"), F.col("question").alias("text"))).select(F.col("pmid").alias("query_id"), "vector")
    docs = encoder.encode(documents(s, d).select("pmid", X.chunk(F.col("title"), F.col("abstract")).alias("text")))
    return vectors.block_top(asked, docs, 10).select("query_id", "rank", "pmid", F.round("score", 6).alias("score"))


def _generated(s, d) -> DataFrame:
    return generation.generate(questions(s, d), _hits(s, d), documents(s, d))


@query()
def generate_answers(s, d):
    """Answers decoded from the passages under the grammar, and whether all their citations are valid."""
    made = _generated(s, d)
    return made.select("query_id", "text", F.size("passages").alias("n_passages"), generation.well_formed(F.col("text"), F.col("passages")).alias("well_formed"))


@query()
def ladder_trained(s, d):
    """The ladder over decoded answers under the trained verifier, for the questions and three that no document answers."""
    off = s.createDataFrame([("off1", "zzxqv wwkkj qqzzt"), ("off2", ""), ("off3", None)], "query_id string, question string")
    asked, docs = questions(s, d).unionByName(off), documents(s, d)
    hits = settled(bm25.search(_index(s, d), asked, 10))
    made = settled(generation.spoken(generation.generate(asked, hits, docs)))
    model = _verifier(s, d).model
    checked = verification.verdicts(made, docs, lambda premise, hypothesis: model.label(learning.pair_features(premise, hypothesis)))
    extracted = answers.render(answers.extract(asked, hits, docs))
    return verification.ladder(asked, made, verification.report(made, checked), extracted).select("query_id", "confidence", F.md5("text").alias("text_md5"))
