"""Disambiguation of a stream of documents: stateless, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "array<array<struct<start: int, end: int, value: string, pos: string, before: string, after: string>>>"


def requests(bodies: DataFrame) -> DataFrame:
    """Token rows of request bodies: {"paragraphs": [[[start, end, value, pos, before, after], ...], ...]} by request id."""
    parsed = bodies.select("id", F.from_json("body", "struct<paragraphs: array<array<array<string>>>>").alias("b"))
    p = parsed.select("id", F.posexplode("b.paragraphs").alias("par_idx", "p"))
    t = p.select("id", "par_idx", F.posexplode("p").alias("tok", "t"))
    return t.select("id", "par_idx", "tok", F.col("t")[0].cast("long").alias("start"), F.col("t")[1].cast("long").alias("end"), F.col("t")[2].alias("value"), F.get("t", F.lit(3)).alias("pos"), F.get("t", F.lit(4)).alias("before"), F.get("t", F.lit(5)).alias("after"))


def responses(found: DataFrame) -> DataFrame:
    """{"results": [{start, end, url}, ...]} by request id, in order of start."""
    r = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "url"))).alias("results"))
    return r.select("id", F.to_json(F.struct("results")).alias("body"))


def run(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], output: str, checkpoint: str):
    """Start a query that writes answer(batch) for each micro-batch; a batch that is run again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
