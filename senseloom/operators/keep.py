"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only on one machine, where that may be unset, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="senseloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df, written once as Parquet: what follows plans from a scan, and a lost executor costs no more than that."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    kept = df.sparkSession.read.schema(df.schema).parquet(at)
    kept._kept_at = at
    return kept


def drop(kept: DataFrame) -> None:
    """Delete what keep() wrote, once nothing needs it."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of 8 MiB at most, unless the session has a bound of its own."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(bound):
        spark.conf.set(bound, str(8 << 20))


def stored(at: str, rows: int) -> Iterator[pa.RecordBatch]:
    """What keep() wrote below at, in its order, so many rows at a time; for tasks."""
    from pyarrow import fs, parquet

    files, base = fs.FileSystem.from_uri(at if ":" in at.split("/")[0] else f"file://{at}")
    for path in sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            yield from (b for b in parquet.ParquetFile(f).iter_batches(rows, use_threads=False) if b.num_rows)
