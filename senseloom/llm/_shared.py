"""What the operators of this subpackage share: tables, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of a batch that goes to a Python worker, unless the session has a bound of its own: both sides hold a batch or two of each task.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere, and get texts in batches of bounded size."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(bound):
        spark.conf.set(bound, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only on one machine (a local master, as in tests) may the setting be missing; a local
    temporary folder is made then, elsewhere it is an error.
    """
    base = _scopes[-1] if _scopes else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            base = set_before.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="senseloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All folders made within are deleted at its end; what is to stay must have been written elsewhere by then."""
    _scopes.append(shared_folder(spark))
    try:
        yield
    finally:
        delete(spark, _scopes.pop())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, as texts become Python objects one slice at a time; at the end a worker gives back what it no longer uses."""
    try:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def fresh(taken: list[str], base: str) -> str:
    """A column name that none of the given ones equals, whatever its case."""
    have = {c.lower() for c in taken}
    while base.lower() in have:
        base += "_"
    return base


class Tables:
    """Intermediate results as Parquet in the shared folder: cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._senseloom_path = path
        return out

    def replace(self, old: DataFrame, df: DataFrame) -> DataFrame:
        """df written; what it takes the place of, if that was a table, is deleted."""
        new = self.write(df)
        if hasattr(old, "_senseloom_path"):
            self.drop(old)
        return new

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._senseloom_path)


def connected_components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is its smallest reachable node.

    Each round takes the smallest label among the neighbours (map-side minimum,
    so a hub's edges are combined before the shuffle) and then jumps to the
    label's label. Labels are written to the shared folder after each round.
    Null ends and self-loops add nothing. Nodes without edges aren't returned. All joins are merges by hint: labels grow with the
    data and are never broadcast.
    """
    both = edges.where("a is not null and b is not null and a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    e = tables.write(both)
    e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = tables.write(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = e.join(labels.hint("merge"), e.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.hint("merge"), labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = tables.write(step.join(up.hint("merge"), "c", "left").select("node", "was", F.least("c", F.coalesce("cc", "c")).alias("component")))
        tables.drop(labels)
        moved = new.where("was <> component").limit(1).count()
        labels = new.drop("was")
        labels._senseloom_path = new._senseloom_path
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
