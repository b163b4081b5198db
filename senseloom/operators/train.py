"""Trainer of the candidate-restricted classifier on hashed features, and its predictions.

Features are hashed to buckets, bucket vectors pooled, passed through optional hidden layers and scored against the
output rows of the candidates alone. An epoch trains every partition from the same
parameters by mini-batch gradient descent and averages the rows that each touched, so what
moves is bounded by the rows in use and never by the examples.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass
class Params:
    buckets: int = 10_000_000
    size: int = 10
    combiner: str = "mean"
    rate: float = 1.0
    decay: float = 0.98
    decay_steps: int = 100_000
    clip: float | None = 1.0
    hidden: tuple[int, ...] = ()
    seed: int = 1


@dataclass
class Model:
    """Rows by bucket and label that training has touched; others have their starting values."""

    params: Params
    embeddings: dict[int, np.ndarray] = field(default_factory=dict)
    outputs: dict[int, np.ndarray] = field(default_factory=dict)  # weights and bias
    layers: list[np.ndarray] = field(default_factory=list)  # weights with the bias as the last row
    step: int = 0

    def __post_init__(self):
        sizes = [self.params.size, *self.params.hidden]
        g = np.random.default_rng(self.params.seed)
        if not self.layers:
            self.layers = [np.vstack([g.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]

    def row(self, bucket: int) -> np.ndarray:
        if bucket not in self.embeddings:
            self.embeddings[bucket] = np.random.default_rng([self.params.seed, bucket]).normal(0, self.params.size**-0.5, self.params.size)
        return self.embeddings[bucket]

    def out(self, label: int) -> np.ndarray:
        if label not in self.outputs:
            self.outputs[label] = np.zeros([self.params.size, *self.params.hidden][-1] + 1)
        return self.outputs[label]

    def forward(self, buckets: list[int]) -> list[np.ndarray]:
        n = max(1, len(buckets))
        x = sum((self.row(b) for b in buckets), np.zeros(self.params.size)) / (n if self.params.combiner == "mean" else n**0.5)
        acts = [x]
        for w in self.layers:
            acts.append(np.maximum(acts[-1] @ w[:-1] + w[-1], 0))
        return acts

    def logits(self, buckets: list[int], labels: list[int]) -> np.ndarray:
        h = self.forward(buckets)[-1]
        w = np.array([self.out(k) for k in labels])
        return w[:, :-1] @ h + w[:, -1]

    def learn(self, batch: list[tuple[list[int], list[int], int]]) -> float:
        """One step; returns the mean loss over each example's own candidates."""
        p, loss = self.params, 0.0
        ge: dict[int, np.ndarray] = {}
        go: dict[int, np.ndarray] = {}
        gl = [np.zeros_like(w) for w in self.layers]
        for buckets, labels, sense in batch:
            acts = self.forward(buckets)
            w = np.array([self.out(k) for k in labels])
            z = w[:, :-1] @ acts[-1] + w[:, -1]
            q = np.exp(z - z.max())
            q /= q.sum()
            k = labels.index(sense)
            loss -= float(np.log(max(q[k], 1e-30)))
            d = q / len(batch)
            d[k] -= 1 / len(batch)
            for x, label in zip(d, labels):
                go[label] = go.get(label, 0) + x * np.append(acts[-1], 1)
            dh = w[:, :-1].T @ d
            for i in range(len(self.layers) - 1, -1, -1):
                dz = dh * (acts[i + 1] > 0)
                gl[i] += np.outer(np.append(acts[i], 1), dz)
                dh = self.layers[i][:-1] @ dz
            n = max(1, len(buckets))
            share = dh / (n if p.combiner == "mean" else n**0.5)
            for b in buckets:
                ge[b] = ge.get(b, 0) + share
        norm = sum(float((g * g).sum()) for g in [*ge.values(), *go.values(), *gl]) ** 0.5
        rate = p.rate * p.decay ** (self.step / p.decay_steps) * (min(1.0, p.clip / norm) if p.clip and norm else 1.0)
        for b, g in ge.items():
            self.embeddings[b] = self.row(b) - rate * g
        for label, g in go.items():
            self.outputs[label] = self.out(label) - rate * g
        for w, g in zip(self.layers, gl):
            w -= rate * g
        self.step += 1
        return loss / len(batch)


def features(examples: DataFrame, params: Params, keep: list[str] | None = None) -> DataFrame:
    """(buckets, possible_senses, sense) and the columns to keep of examples(tokens, possible_senses, sense)."""
    return examples.withColumn("buckets", F.transform("tokens", lambda t: text.bucket(t, params.buckets))).select(*(keep or []), "buckets", "possible_senses", "sense")


def train_epoch(examples: DataFrame, model: Model, batch_size: int) -> tuple[Model, float]:
    sent = examples.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = sent.value
        m = Model(m.params, dict(m.embeddings), dict(m.outputs), [w.copy() for w in m.layers], m.step)
        touched_e, touched_o, losses = set(), set(), []
        for pdf in frames:
            rows = [([int(b) for b in x], [int(c) for c in y], int(z)) for x, y, z in zip(pdf.buckets, pdf.possible_senses, pdf.sense)]
            for lo in range(0, len(rows), batch_size):
                batch = rows[lo : lo + batch_size]
                losses.append((m.learn(batch), len(batch)))
                for x, y, _ in batch:
                    touched_e.update(x)
                    touched_o.update(y)
        if losses:
            out = [("e", k, m.embeddings[k]) for k in touched_e] + [("o", k, m.outputs[k]) for k in touched_o]
            out += [("h", k, w.ravel()) for k, w in enumerate(m.layers)] + [("l", m.step, np.array([sum(a * n for a, n in losses), sum(n for _, n in losses)]))]
            yield pd.DataFrame({"kind": [x[0] for x in out], "id": [x[1] for x in out], "row": [np.asarray(x[2], float).tolist() for x in out]})

    rows = examples.mapInPandas(run, "kind string, id long, row array<double>").withColumn("id", F.when(F.col("kind") == "l", 0).otherwise(F.col("id")))
    at = rows.select("kind", "id", F.posexplode("row").alias("i", "x")).groupBy("kind", "id", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    merged = at.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"), F.max("n").alias("n")).select("kind", "id", "n", F.expr("transform(r, y -> y.x)").alias("row"))
    new = Model(model.params, dict(model.embeddings), dict(model.outputs), [w.copy() for w in model.layers], model.step)
    loss = 0.0
    for r in merged.toLocalIterator():
        x = np.array(r.row)
        if r.kind == "e":
            new.embeddings[r.id] = x
        elif r.kind == "o":
            new.outputs[r.id] = x
        elif r.kind == "h":
            new.layers[r.id] = x.reshape(new.layers[r.id].shape)
        else:
            loss = float(x[0] / max(x[1], 1e-9))
    new.step = model.step + max(1, -(-examples.count() // batch_size))
    sent.unpersist()
    return new, loss


def train(examples: DataFrame, params: Params, epochs: int, batch_size: int = 32, snapshots: str | None = None) -> tuple[Model, list[float]]:
    """Parameters after so many epochs and the loss of each. snapshots: a folder for the model after each epoch, of which the last two stay."""
    data, model, losses = features(examples, params).persist(), Model(params), []
    for k in range(epochs):
        model, loss = train_epoch(data, model, batch_size)
        losses.append(loss)
        if snapshots:
            save(model, examples.sparkSession, f"{snapshots}/epoch={k}")
            if k >= 2:
                old = examples.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{snapshots}/epoch={k - 2}")
                old.getFileSystem(examples.sparkSession._jsc.hadoopConfiguration()).delete(old, True)
    data.unpersist()
    return model, losses


def train_until(examples: DataFrame, dev: DataFrame, params: Params, least_slope: float, over: int = 3, batch_size: int = 32, most: int = 100, flip: bool = False) -> tuple[Model, list[float]]:
    """Epochs until the moving average of the metric on dev gains less than least_slope. flip: the metric is a loss."""
    data, model, values = features(examples, params).persist(), Model(params), []
    for _ in range(most):
        model, loss = train_epoch(data, model, batch_size)
        if flip:
            values.append(-loss)
        else:
            values.append(predict(dev, model).agg(F.avg((F.col("predicted") == F.col("sense")).cast("double"))).first()[0] or 0.0)
        if len(values) > over and (sum(values[-over:]) - sum(values[-over - 1 : -1])) / over < least_slope:
            break
    data.unpersist()
    return model, values


def predict(examples: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(sense, predicted) and the columns to keep: the first best of each example's own candidates."""
    sent = examples.sparkSession.sparkContext.broadcast(model)
    data = features(examples, model.params, keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            best = [int(y[int(np.argmax(sent.value.logits([int(b) for b in x], [int(c) for c in y])))]) for x, y in zip(pdf.buckets, pdf.possible_senses)]
            yield pdf[[*(keep or []), "sense"]].assign(predicted=best)

    return data.mapInPandas(run, data.select(*(keep or []), "sense").schema.add("predicted", "long"))


def save(model: Model, spark, path: str) -> None:
    """Tables embeddings(bucket, vec), out_layer(label, w, b), hidden(layer, w) and params below path."""
    from dataclasses import asdict

    e = [(int(k), [float(x) for x in v]) for k, v in model.embeddings.items()]
    o = [(int(k), [float(x) for x in v[:-1]], float(v[-1])) for k, v in model.outputs.items()]
    h = [(k, [float(x) for x in w.ravel()]) for k, w in enumerate(model.layers)]
    spark.createDataFrame(e, "bucket long, vec array<double>").write.parquet(f"{path}/embeddings")
    spark.createDataFrame(o, "label long, w array<double>, b double").write.parquet(f"{path}/out_layer")
    spark.createDataFrame(h, "layer int, w array<double>").write.parquet(f"{path}/hidden")
    spark.createDataFrame([(json.dumps(asdict(model.params) | {"step": model.step}),)], "params string").coalesce(1).write.parquet(f"{path}/params")


def load(spark, path: str) -> Model:
    """The model that save() wrote. For scores of many texts join load_tables() instead: there nothing reaches the driver."""
    p = json.loads(spark.read.parquet(f"{path}/params").first().params)
    step = p.pop("step")
    params = Params(**(p | {"hidden": tuple(p["hidden"])}))
    e, o = load_tables(spark, path)
    model = Model(params, step=step)
    model.embeddings = {r.bucket: np.array(r.vec) for r in e.toLocalIterator()}
    model.outputs = {r.label: np.array([*r.w, r.b]) for r in o.toLocalIterator()}
    sizes = [params.size, *params.hidden]
    rows = {r.layer: r.w for r in spark.read.parquet(f"{path}/hidden").collect()}
    model.layers = [np.array(rows[k]).reshape(a + 1, b) for k, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    return model


def load_tables(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(bucket, vec) and (label, w, b) of a saved model, for pool() and logits()."""
    return spark.read.parquet(f"{path}/embeddings"), spark.read.parquet(f"{path}/out_layer")
