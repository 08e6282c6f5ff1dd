"""Models trained in rounds: gradients of blocks summed in a tree, and a step on a bounded block of parameters.

Training rows are dealt once to blocks, and blocks to slices, by hashes of their values. A step is one job over one slice: each task
adds up the gradients of its blocks under the parameters that the driver broadcasts, the tasks' sums meet ``FAN`` at a time, and the driver, which
never holds more than the parameters and FAN sums of their size, takes the step. Sums are whole multiples of a small unit, so they are the same in
whatever order and tasks they are taken, and so are the weights for the same rows and seed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

from . import evaluation
from .storage import settled

#: Rows of a block, sums that meet in one place, and the unit of sums.
BLOCK_ROWS, FAN, UNIT = 256, 16, 2.0**-48

#: Format of saved models.
FORMAT_VERSION = 1

Parameters = dict[str, np.ndarray]
#: Of parameters and a block's rows: summed loss, and gradients by parameter.
Gradient = Callable[[Parameters, pa.StructArray], tuple[float, Parameters]]


def hashed(terms: Column, dim: int) -> Column:
    """Places of terms in a vector of ``dim`` places, one for each occurrence."""
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))


@dataclass
class Blocks:
    """Training rows as one row for each block: table(slice, rows), and the weight of each slice."""

    table: DataFrame
    weights: dict[int, float]

    @classmethod
    def of(cls, rows: DataFrame, *, steps: int, seed: int = 0, weight: Column | None = None, block_rows: int = BLOCK_ROWS) -> Blocks:
        """``rows`` in ``steps`` slices, of ``weight`` each. Rows that many equal are spread over all slices, as one row in each with its part of their weight."""
        names = rows.columns
        share = F.col("n") / F.least("n", F.lit(steps)) * (F.lit(1.0) if weight is None else weight)
        same = rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("w", share).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(steps)).cast("int"))))
        same = settled(same.withColumn("key", F.xxhash64(F.lit(seed), "copy", *names)).withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), *names) + F.col("copy"), F.lit(steps)).cast("int")))
        blocks = max(1, -(-same.count() // (steps * block_rows)))
        packed = same.groupBy("slice", F.pmod("key", F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("key", "w", *names))).alias("rows"))
        table = settled(packed.select("slice", "rows"), by="slice")
        sums = table.groupBy("slice").agg(F.sum(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["w"])).alias("w")).collect()  # a row for each slice
        return cls(table, {r["slice"]: r["w"] for r in sums})


def _layout(start: Parameters) -> list[tuple[str, tuple[int, ...], int]]:
    return [(k, v.shape, v.size) for k, v in sorted(start.items())]


def summed(data: Blocks, part: int, params: Parameters, gradient: Gradient) -> tuple[float, Parameters]:
    """Mean loss and gradients over a slice."""
    rows = data.table.filter(F.col("slice") == part).select("rows")
    total, layout = data.weights[part], _layout(params)
    size = 1 + sum(n for *_, n in layout)
    held = rows.sparkSession.sparkContext.broadcast(params)  # of the parameters' own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for block in batch.column("rows"):
                loss, g = gradient(held.value, block.values)
                flat = np.concatenate([[loss], *[g[k].ravel() for k, *_ in layout]])
                sums += np.rint(flat / (total * UNIT)).astype(np.int64)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        sums = np.zeros(size, np.int64)
        for b in t.column("sums"):
            sums += np.frombuffer(b.as_buffer(), np.int64)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "task int, sums binary")
    tasks = rows.rdd.getNumPartitions()  # of the plan; no job
    while tasks > FAN:
        found = found.withColumn("task", F.expr(f"task div {FAN}").cast("int")).groupBy("task").applyInArrow(add, "task int, sums binary")
        tasks = -(-tasks // FAN)
    flat = sum((np.frombuffer(r["sums"], np.int64) for r in found.collect()), np.zeros(size, np.int64)) * UNIT  # FAN rows at most
    held.destroy()
    out, at = {}, 1
    for k, shape, n in layout:
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return float(flat[0]), out


@dataclass
class Adam:
    """Steps by running means of gradients and of their squares."""

    rate: float
    first: Parameters = field(default_factory=dict)
    second: Parameters = field(default_factory=dict)
    n: int = 0

    def step(self, params: Parameters, grads: Parameters) -> Parameters:
        self.n += 1
        out = {}
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            m, v = self.first[k] / (1 - 0.9**self.n), self.second[k] / (1 - 0.999**self.n)
            out[k] = params[k] - self.rate * m / (np.sqrt(v) + 1e-8)
        return out


def descend(data: Blocks, start: Parameters, gradient: Gradient, *, epochs: int, rate: float, on_epoch: Callable[[int, Parameters], None] | None = None) -> tuple[Parameters, list[float]]:
    """Parameters after ``epochs`` passes, a step for each slice, and the mean loss of each pass; ``on_epoch`` sees the parameters after each, from 1."""
    params, adam, losses = {k: np.array(v, float) for k, v in start.items()}, Adam(rate), []
    every = sum(data.weights.values())
    for epoch in range(1, epochs + 1):
        loss = 0.0
        for part in sorted(data.weights):
            mean, grads = summed(data, part, params, gradient)
            params = adam.step(params, grads)
            loss += mean * data.weights[part] / every
        losses.append(loss)
        if on_epoch:
            on_epoch(epoch, params)
    return params, losses


# Hashed terms with a linear projection, trained on pairs by contrast within blocks.


def unit_counts(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Damped counts of places, as rows of unit length; zero for empty lists."""
    size = np.diff(lists.offsets.to_numpy())
    at = np.repeat(np.arange(len(lists)), size) * dim + lists.flatten().to_numpy()
    x = np.log1p(np.bincount(at, minlength=len(lists) * dim).reshape(len(lists), dim).astype(float))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def contrast(dim: int, temperature: float) -> Gradient:
    """Symmetric InfoNCE of rows (w, a, b): each a must find its own b among those of its block, and the other way round; equal ones don't count against each other."""

    def half(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        return z / n, n

    def gradient(p: Parameters, rows: pa.StructArray) -> tuple[float, Parameters]:
        w = rows.field("w").to_numpy()
        xa, xb = (unit_counts(rows.field(c), dim) for c in ("a", "b"))
        (a, na), (b, nb) = half(xa @ p["projection"]), half(xb @ p["projection"])
        s = a @ b.T / temperature
        same = lambda x: (x @ x.T > 1 - 1e-9) & ~np.eye(len(x), dtype=bool)
        s[same(xa) | same(xb)] = -np.inf
        own = np.arange(len(w))
        grad, loss = np.zeros_like(s), 0.0
        for axis in (1, 0):
            e = np.exp(s - s.max(axis=axis, keepdims=True))
            soft = e / e.sum(axis=axis, keepdims=True)
            loss -= 0.5 * float(w @ np.log(np.maximum(soft[own, own], 1e-300)))
            soft[own, own] -= 1
            grad += 0.5 * soft * (w[:, None] if axis == 1 else w[None, :]) / temperature
        da, db = grad @ b, grad.T @ a
        back = lambda d, u, n: (d - u * (d * u).sum(1, keepdims=True)) / n
        return loss, {"projection": xa.T @ back(da, a, na) + xb.T @ back(db, b, nb)}

    return gradient


@dataclass
class Encoder:
    """Texts as unit vectors: damped counts of hashed terms times a matrix of dim x width numbers."""

    projection: np.ndarray

    @classmethod
    def untrained(cls, dim: int = 4096, width: int = 64, seed: int = 0) -> Encoder:
        return cls(np.random.default_rng(seed).standard_normal((dim, width)) / math.sqrt(width))

    def train(self, pairs: DataFrame, *, epochs: int = 5, steps: int = 4, rate: float = 0.01, temperature: float = 0.05, seed: int = 0, on_epoch: Callable[[int, Encoder], None] | None = None) -> tuple[Encoder, list[float]]:
        """A new encoder, and the mean loss of each epoch, of pairs(anchor, positive) of texts that belong together. Null and empty texts are no pairs."""
        dim = len(self.projection)
        rows = pairs.select(*[hashed(X.terms(F.col(c)), dim).alias(n) for c, n in (("anchor", "a"), ("positive", "b"))])
        rows = rows.select(F.inline(F.when((F.size("a") > 0) & (F.size("b") > 0), F.array(F.struct("a", "b"))).otherwise(F.array().cast("array<struct<a:array<int>,b:array<int>>>"))))  # a filter would cut terms again
        told = on_epoch and (lambda epoch, p: on_epoch(epoch, Encoder(p["projection"])))
        params, losses = descend(Blocks.of(rows, steps=steps, seed=seed), {"projection": self.projection}, contrast(dim, temperature), epochs=epochs, rate=rate, on_epoch=told)
        return Encoder(params["projection"]), losses

    def vector(self, spark: SparkSession, text: Column) -> Column:
        """The vector of a text; zero for one without terms."""
        dim = len(self.projection)
        held = spark.sparkContext.broadcast(self.projection)

        @F.arrow_udf("array<double>")
        def vectors(places: pa.Array) -> pa.Array:
            out = [np.zeros((0, held.value.shape[1]))]
            for at in range(0, len(places), BLOCK_ROWS):
                z = unit_counts(places.slice(at, BLOCK_ROWS), dim) @ held.value
                out.append(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
            flat = np.concatenate(out)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))

        return vectors(hashed(X.terms(F.coalesce(text, F.lit(""))), dim))

    def encode(self, texts: DataFrame) -> DataFrame:
        """(pmid, vector) of texts(pmid, text); zero for a text without terms."""
        return texts.select("pmid", self.vector(texts.sparkSession, F.col("text")).alias("vector"))

    def save(self, spark: SparkSession, path: str) -> None:
        _save(spark, path, "encoder", {"projection": self.projection})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        return cls(_load(spark, path, "encoder")[0]["projection"])


# Weighted multinomial models of dense features and hashed terms.


def multinomial(classes: int, dim: int, penalty: float) -> Gradient:
    """Cross-entropy of rows (w, x, label, terms), with half ``penalty`` times the squared weights for each unit of weight."""

    def gradient(p: Parameters, rows: pa.StructArray) -> tuple[float, Parameters]:
        w, label = rows.field("w").to_numpy(), rows.field("label").to_numpy()
        x, t = _inputs(rows.field("x"), rows.field("terms"), dim)
        soft = softmax(x @ p["dense"] + (t @ p["hashed"] if dim else 0))
        loss = -float(w @ np.log(np.maximum(soft[np.arange(len(w)), label], 1e-300)))
        soft[np.arange(len(w)), label] -= 1
        d = soft * w[:, None]
        out = {"dense": x.T @ d + penalty * w.sum() * p["dense"]}
        if dim:
            out["hashed"] = t.T @ d + penalty * w.sum() * p["hashed"]
        return loss + 0.5 * penalty * w.sum() * sum(float((v * v).sum()) for v in p.values()), out

    return gradient


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _inputs(x: pa.ListArray, terms: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    dense = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
    return np.column_stack([np.ones(len(x)), dense]), unit_counts(terms, dim) if dim else None


@dataclass
class Classifier:
    """Probabilities of classes 0 to classes - 1 from features x (array<double>) and, where ``dim`` isn't 0, hashed terms (array<int>)."""

    params: Parameters
    dim: int
    temperature: float = 1.0

    @property
    def classes(self) -> int:
        return self.params["dense"].shape[1]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probability (array<double>)."""
        held = rows.sparkSession.sparkContext.broadcast((self.params, self.temperature))
        dim = self.dim

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array, terms: pa.Array) -> pa.Array:
            p, temperature = held.value
            out = []
            for at in range(0, len(x), BLOCK_ROWS):
                d, t = _inputs(x.slice(at, BLOCK_ROWS), terms.slice(at, BLOCK_ROWS), dim)
                out += list(softmax((d @ p["dense"] + (t @ p["hashed"] if dim else 0)) / temperature))
            return pa.array(out, pa.list_(pa.float64()))

        terms = F.col("terms") if dim else F.array().cast("array<int>")
        return rows.withColumn("probability", scored("x", terms))

    def scores(self, x: list[Column]) -> Column:
        """Probabilities of dense features in built-in functions; for models without hashed terms."""
        if self.dim:
            raise ValueError("a model of hashed terms has no such form")
        once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  a value used often is computed once
        z = lambda v: F.array(*[sum((float(c) * v[i] for i, c in enumerate(w[1:])), F.lit(float(w[0]))) / self.temperature for w in self.params["dense"].T])
        e = lambda v: F.transform(v, lambda c: F.exp(c - F.array_max(v)))
        whole = lambda v: F.transform(v, lambda c: c / F.aggregate(v, F.lit(0.0), lambda a, b: a + b))
        return once(F.array(*x), lambda v: once(z(v), lambda u: once(e(u), whole)))

    def label(self, x: list[Column]) -> Column:
        """The likeliest class of dense features, the smaller of equals."""
        return F.get(F.transform(F.array(self.scores(x)), likeliest), F.lit(0))

    def save(self, spark: SparkSession, path: str) -> None:
        _save(spark, path, "classifier", self.params, {"dim": self.dim, "temperature": self.temperature})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        params, more = _load(spark, path, "classifier")
        return cls(params, more["dim"], more["temperature"])


def likeliest(probability: Column) -> Column:
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


@dataclass
class Fitted:
    """A classifier of the best epoch, and (epoch, loss, accuracy on held-out rows) of all."""

    model: Classifier
    history: list[tuple[int, float, float]]


def accuracy_of(model: Classifier, rows: DataFrame) -> float:
    """Share of rows(x, label[, terms]) whose likeliest class is theirs; 0 without rows."""
    right = model.probabilities(rows).select((likeliest(F.col("probability")) == F.col("label")).cast("int").alias("r"))
    return right.agg(F.coalesce(F.avg("r"), F.lit(0.0))).first()[0]


def fit_classifier(rows: DataFrame, held: DataFrame, *, classes: int, dim: int = 0, weighted: bool = True, epochs: int = 8, steps: int = 4, rate: float = 0.05, penalty: float = 1e-4, seed: int = 0, on_epoch: Callable[[int, Classifier], None] | None = None) -> Fitted:
    """A classifier of rows(x, label[, terms]), with the parameters of the epoch that is best on ``held``, the earliest of equals, and calibrated on it.

    Features are brought to mean 0 and deviation 1 for the training. With ``weighted`` each class counts as much as any other. Without training rows every class is as likely. Null labels take no part.
    """
    if not dim:
        rows, held = (r.withColumn("terms", F.array().cast("array<int>")) for r in (rows, held))
    rows, held = (r.filter(F.col("label").isNotNull()).select("x", F.col("label").cast("int").alias("label"), "terms") for r in (rows, held))
    rows, held = settled(rows), settled(held)
    first = rows.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    start: Parameters = {"dense": np.zeros((1 + width, classes))} | ({"hashed": np.zeros((dim, classes))} if dim else {})
    if first is None:
        return Fitted(Classifier(start, dim), [])
    spread = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    mean, scale = np.array(spread[:width], float), np.array([v if v > 1e-9 else 1.0 for v in spread[width:]], float)
    array = lambda v: F.array(*[F.lit(float(c)) for c in v]) if len(v) else F.array().cast("array<double>")
    even = rows.withColumn("x", F.zip_with(F.zip_with("x", array(mean), lambda x, m: x - m), array(scale), lambda x, c: x / c))

    def of_given(p: Parameters) -> Parameters:
        """The parameters for features as they are given, of those for features around 0."""
        w = p["dense"][1:] / scale[:, None]
        return p | {"dense": np.vstack([p["dense"][:1] - mean @ w, w])}

    weight = None
    if weighted:
        by_class = {r["label"]: r["weight"] for r in evaluation.class_weights(rows, classes).collect()}
        weight = F.element_at(F.array(*[F.lit(float(by_class[c])) for c in range(classes)]), F.col("label") + 1)
    seen: list[tuple[float, Parameters]] = []

    def after(epoch: int, params: Parameters) -> None:
        model = Classifier(of_given(params), dim)
        seen.append((accuracy_of(model, held), model.params))
        if on_epoch:
            on_epoch(epoch, model)

    _, losses = descend(Blocks.of(even, steps=steps, seed=seed, weight=weight), start, multinomial(classes, dim, penalty), epochs=epochs, rate=rate, on_epoch=after)
    best = max(range(len(seen)), key=lambda i: (seen[i][0], -i))
    return Fitted(calibrated(Classifier(seen[best][1], dim), held), [(i + 1, loss, a) for i, (loss, (a, _)) in enumerate(zip(losses, seen))])


#: Temperatures that calibration tries.
TEMPERATURES = np.exp(np.linspace(math.log(0.2), math.log(5), 41))


def calibrated(model: Classifier, rows: DataFrame) -> Classifier:
    """``model`` with the temperature under which rows(x, label, terms) have the least cross-entropy, by one pass over them; the nearest to 1 of equals."""
    plain = Classifier(model.params, model.dim)
    log_p = plain.probabilities(rows).select("label", F.transform("probability", lambda p: F.log(F.greatest(p, F.lit(1e-300)))).alias("z"))
    loss = lambda t: F.sum(F.log(F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z / t))) - F.element_at("z", F.col("label") + 1) / t)
    sums = log_p.agg(*[loss(float(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    if sums[0] is None:
        return plain
    best = min(range(len(TEMPERATURES)), key=lambda i: (round(sums[i], 9), abs(math.log(TEMPERATURES[i]))))
    return Classifier(model.params, model.dim, float(TEMPERATURES[best]))


# Saved models: JSON of kind and format beside the numbers.


def _save(spark: SparkSession, path: str, kind: str, params: Parameters, more: dict | None = None) -> None:
    numbers = [(k, list(v.shape), v.astype(float).ravel().tolist()) for k, v in sorted(params.items())]
    spark.createDataFrame(numbers, "name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(f"{path}/parameters")
    about = json.dumps({"kind": kind, "format": FORMAT_VERSION, **(more or {})}, sort_keys=True)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def _load(spark: SparkSession, path: str, kind: str) -> tuple[Parameters, dict]:
    """Parameters and settings; ValueError if it is another kind of model or of another format."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if about.get("kind") != kind or about.get("format") != FORMAT_VERSION:
        raise ValueError(f"{path} holds a {about.get('kind')} of format {about.get('format')}, not a {kind} of format {FORMAT_VERSION}")
    rows = spark.read.parquet(f"{path}/parameters").collect()  # of the parameters' own size
    return {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows}, about


# What the trained verifier, gate and answer classes look at.


def _neighbours(terms: Column) -> Column:
    """Each term with the next: the first and second, third and fourth and so on, then the second and third and so on."""
    line = F.array_join(terms, " ")
    pairs = lambda t: F.regexp_extract_all(t, F.lit("[^ ]+ [^ ]+"), F.lit(0))
    return F.concat(pairs(line), pairs(F.regexp_replace(line, "^[^ ]* ?", "")))


def _steps(terms: Column) -> Column:
    """``_neighbours`` as a 64-bit hash of each two, in order; two different ones of a text share one with odds of less than its number of terms squared in 2^65."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _shares(said: Column, next_to: Column, held: Column, held_next: Column, some: Column) -> list[Column]:
    """The features of a hypothesis of the terms ``said`` and neighbours ``next_to``, of those that the premise has, and whether it has content; others in ``held`` don't count."""
    share = lambda part, whole: F.coalesce(F.try_divide(F.size(F.array_intersect(part, whole)), F.size(F.array_distinct(part))), F.lit(0.0))  # noqa: E731  a nullif would be a projection of its own, and the parts made twice
    half = F.ceil(F.size(said) / 2).cast("int")
    content = lambda terms: F.array_except(terms, F.array(*map(F.lit, X.STOPWORDS)))
    first, second = content(F.slice(said, F.lit(1), half)), content(F.slice(said, half + 1, F.size(said)))
    return [share(content(said), held), share(first, held), share(second, held), share(next_to, held_next), F.when(some, 1.0).otherwise(0.0)]


def pair_features(premise: Column, hypothesis: Column) -> list[Column]:
    """How much of the hypothesis the premise has: content terms, those of each half, and neighbouring terms; and whether there is any."""
    held, said = X.content_terms(premise), X.terms(hypothesis)
    return _shares(said, _neighbours(said), held, _neighbours(X.terms(premise)), F.size(held) > 0)


def sentence_pairs(docs: DataFrame, *, neighbours: int = 1000) -> DataFrame:
    """(pmid, premise, hypothesis, label) for a verifier to learn from docs(pmid, title, abstract) that nobody has labelled.

    Each document of two sentences or more gives three rows: its own longest sentence (entailment, 0), that of another document (neutral, 1),
    and its own first half with the other's second (contradiction, 2). The other is the next of about ``neighbours`` that share a hash, in order of
    another hash; where it holds the same sentence, as copies do, there are only the first.
    """
    return _sentence_rows(docs, neighbours).select("pmid", "premise", F.inline("rows"))


def _sentence_rows(docs: DataFrame, neighbours: int = 1000) -> DataFrame:
    """(pmid, premise, rows) of ``sentence_pairs``, a row for each document: rows are its (hypothesis, label)."""
    chunk = X.chunk(F.col("title"), F.col("abstract"))
    each = docs.select("pmid", chunk.alias("premise"), X.sentences(F.col("abstract")).alias("ss"))
    longest = F.array_max(F.transform("ss", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    own = each.select("pmid", "premise", F.explode(F.when(F.size("ss") >= 2, F.array(longest)).otherwise(F.array().cast("array<string>"))).alias("own"))  # a filter would cut sentences again
    parts = max(1, docs.count() // neighbours)
    w = Window.partitionBy("part").orderBy("place", "pmid")
    ring = own.withColumn("part", F.pmod(F.xxhash64("pmid"), F.lit(parts))).withColumn("place", F.xxhash64(F.lit(1), "pmid"))
    paired = ring.withColumn("other", F.coalesce(F.lead("own").over(w), F.first("own").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    a, b = X.words(F.col("own")), X.words(F.col("other"))
    half = lambda x: F.ceil(F.size(x) / 2).cast("int")
    mixed = F.array_join(F.concat(F.slice(a, F.lit(1), half(a)), F.slice(b, half(b) + 1, F.size(b))), " ")
    row = lambda h, label: F.struct(h.alias("hypothesis"), F.lit(label).alias("label"))
    true = F.array(row(F.col("own"), 0))
    rows = F.when(F.contains("premise", F.col("other")), true).otherwise(F.concat(true, F.array(row(F.col("other"), 1), row(mixed, 2))))
    return paired.select("pmid", "premise", rows.alias("rows"))


def pair_examples(docs: DataFrame, *, held_out: Column) -> DataFrame:
    """(held, x, label) of ``sentence_pairs`` with pair_features as x, computed and kept.

    A premise is cut into terms and pairs of neighbours once for all its hypotheses: what these have of it together is found first, and each hypothesis is compared with that.
    Pairs are compared as 64-bit hashes.
    """
    said = F.transform("rows", lambda r: F.struct(X.terms(r["hypothesis"]).alias("said"), r["label"].alias("label")))
    cut = _sentence_rows(docs).select(held_out.alias("held"), X.terms(F.col("premise")).alias("terms"), said.alias("rows"))
    every = F.flatten(F.transform("rows", lambda r: r["said"]))
    next_to = F.flatten(F.transform("rows", lambda r: _steps(r["said"])))
    some = F.exists("terms", lambda t: ~t.isin(X.STOPWORDS))
    met = cut.select("held", "rows", F.array_intersect(every, F.col("terms")).alias("had"), F.array_intersect(next_to, _steps(F.col("terms"))).alias("had_next"), some.alias("some"))
    one = met.select("held", F.explode_outer("rows").alias("r"), "had", "had_next", "some")  # each has rows; the plain form would filter by rows that it makes again
    return settled(one.select("held", F.array(*_shares(F.col("r.said"), _steps(F.col("r.said")), F.col("had"), F.col("had_next"), F.col("some"))).alias("x"), F.col("r.label").alias("label")))


def fit_verifier(examples: DataFrame, *, epochs: int = 8, **options) -> Fitted:
    """A classifier of pair_features into entailment, neutral and contradiction, by ``pair_examples``, of which the held ones choose the epoch and calibrate."""
    return fit_classifier(examples.filter("NOT held"), examples.filter("held"), classes=3, epochs=epochs, **options)


def fit_gate(examples: DataFrame, *, epochs: int = 8, **options) -> Fitted:
    """A classifier of pair_features of passages and a question into 0, can't be answered from them, and 1: a sentence of theirs, against one of others."""
    rows = examples.filter("label < 2").withColumn("label", 1 - F.col("label"))
    return fit_classifier(rows.filter("NOT held"), rows.filter("held"), classes=2, epochs=epochs, **options)


def train_verifier(docs: DataFrame, *, held_out: Column, **options) -> Fitted:
    """``fit_verifier`` of documents; those of ``held_out`` choose the epoch and calibrate."""
    return fit_verifier(pair_examples(docs, held_out=held_out), **options)


def train_gate(docs: DataFrame, *, held_out: Column, **options) -> Fitted:
    """``fit_gate`` of documents; those of ``held_out`` choose the epoch and calibrate."""
    return fit_gate(pair_examples(docs, held_out=held_out), **options)


def text_features(text: Column, dim: int) -> list[Column]:
    """x and terms of a text for a classifier with hashed terms: lengths, letters and lines, and all terms."""
    n = F.length(text)
    letters, lines = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")), n - F.length(F.replace(text, F.lit("\n"), F.lit("")))  # regexp_count makes a string of each letter
    x = F.array(F.log1p(n), F.log1p(F.size(X.words(text))), F.coalesce(letters / F.nullif(n, F.lit(0)), F.lit(0.0)), F.log1p(lines))
    return [x.cast("array<double>").alias("x"), hashed(X.terms(text), dim).alias("terms")]
