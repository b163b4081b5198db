"""Preparation of a training corpus in five stages, from documents to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from senseloom.llm import decontam, packing, pii, quality, simhash
from senseloom.llm._shared import Tables, fresh, scratch, ship, table
from senseloom.llm.queries import END_ID, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    Every row is scored by its own text, a null or empty one like any other; repeated rows stay or go together. Columns stay
    as they are, whatever their names. An empty table gives none.
    """
    ship(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    name = fresh(docs.columns, "score")
    return quality.score(docs, model, tuple(docs.columns), name).where(F.col(name) >= 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates; of repeated rows with its id, one with the smallest text.

    Documents without an id stay, all of them; a null or empty text is a text like any other (fingerprint zero). An
    empty table gives none. What goes is decided on ids and numbers alone and written down; texts pass
    by it in one anti join, but for repeated ids, of which the smallest text is taken by a minimum that is combined before its shuffle.
    """
    ship(spark)
    tables = Tables(spark)
    at = fresh(docs.columns, "marked")
    found = simhash.near_duplicates(docs.where("doc_id is not null"))
    decided = found.groupBy(F.col("doc_id").alias(at)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))
    marked = tables.write(decided.where("not kept or n > 1"))
    stay = docs.join(marked.select(at), F.col("doc_id") == F.col(at), "left_anti")
    repeated = marked.where("kept and n > 1").select(at)
    if repeated.isEmpty():
        return stay
    rows = docs.join(repeated, F.col("doc_id") == F.col(at), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    order = F.struct("r.text", F.to_json("r"))
    one = rows.groupBy("r.doc_id").agg(F.min_by("r", order).alias("r")).select("r.*")
    return stay.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item.

    Of rows with one id all go if one of them is hit; rows without an id count as having one id. Null and empty texts hold no window and
    stay. An empty table gives none, an empty benchmark drops none.
    """
    name = fresh(docs.columns, "hit")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hit = Tables(spark).write(found.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; every row stays, null and empty texts as they are. An empty table gives none."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1,024 tokens.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed like any other. An empty table gives none.
    """
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID, 1024, {"ids_crc32": F.crc32("ids")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next begins; what a stage wrote besides its result is deleted then, and so is the result of the stage before."""
    ship(spark)
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            made = tables.write(stage(spark, docs, sf_dir))
        if k:
            tables.drop(docs)
        docs = made
    return docs
