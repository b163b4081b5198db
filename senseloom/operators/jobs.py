"""Training jobs: from a list of descriptions to saved models, their metrics and what went into them."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dumps import Descriptor, Job
from . import metrics, train


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text in one file of the folder, on whatever file system it is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x00").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value.rstrip("\x00")


def export(model: train.Model, spark: SparkSession, path: str, descriptor: Descriptor, senses: DataFrame | None = None) -> None:
    """The model's tables, and as assets the descriptor of its features and the table of its senses."""
    train.save(model, spark, path)
    write_text(spark, f"{path}/assets/descriptor", json.dumps(asdict(descriptor)))
    if senses is not None:
        senses.write.parquet(f"{path}/assets/senses")


def load_export(spark: SparkSession, path: str) -> tuple[train.Model, Descriptor]:
    return train.load(spark, path), Descriptor(**json.loads(read_text(spark, f"{path}/assets/descriptor")))


def evaluate(model: train.Model, examples: DataFrame) -> dict[str, float | int | None]:
    p = train.predict(examples, model)
    return metrics.accuracy(p).first().asDict() | metrics.per_class_accuracy(p).first().asDict()


def run_job(spark: SparkSession, job: Job, root: str, out: str, descriptor: Descriptor | None = None) -> dict:
    """Train a job on examples(tokens, possible_senses, sense) below root/dataset/set, save the model, and return what info holds.

    With a target (metric slope, window, and whether smaller is better) epochs go on until the metric's moving
    average gains too little; else there are as many as the job says. Every epoch leaves a snapshot, of which two stay.
    """
    read = lambda name: spark.read.parquet(f"{root}/{job.dataset_name}/{name}")
    sets = [read(n) for n in job.train_sets]
    examples = sets[0]
    for s in sets[1:]:
        examples = examples.unionByName(s)
    known = {f.name for f in fields(train.Params)}
    params = train.Params(**{k: tuple(v) if isinstance(v, list) else v for k, v in job.params.items() if k in known})
    began, path = time.time(), f"{out}/{job.model_name}"
    if job.target:
        model, values = train.train_until(examples, read(job.test_sets[0]), params, job.target["slope"], job.target.get("over", 3), job.batch_size, job.target.get("most", 100), job.target.get("flip", False))
    else:
        model, values = train.train(examples, params, job.epochs or 1, job.batch_size, f"{path}/snapshots")
    trained = time.time()
    results = {n: evaluate(model, read(n)) for n in job.test_sets}
    export(model, spark, f"{path}/model", descriptor or Descriptor())
    info = {"model": job.model_name, "dataset": job.dataset_name, "params": asdict(params), "values": values, "results": results, "train_seconds": trained - began, "test_seconds": time.time() - trained}
    write_text(spark, f"{path}/info", json.dumps(info))
    return info


def run_jobs(spark: SparkSession, jobs: list[Job], root: str, out: str) -> list[dict]:
    """The jobs one after the other, each distributed; a job of which info was written is not run again."""
    done = []
    for job in jobs:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{job.model_name}/info/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            done.append(json.loads(read_text(spark, f"{out}/{job.model_name}/info")))
        else:
            done.append(run_job(spark, job, root, out))
    return done


def console(spark: SparkSession, lines) -> DataFrame:
    """(doc_id, text) of one text read from lines, each of which keeps its own end, joined by one more."""
    return spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")


def console_tree(found: DataFrame) -> list[str]:
    """Lines for found(start, end, url, nested) of one text: by start, longer ones first, what lies within another one indented."""
    rows = found.orderBy("start", F.desc("end")).select("start", "end", "url", "nested").toLocalIterator()
    return [f"{'  ' * r.nested}{r.start}-{r.end} {r.url}" for r in rows]
