"""The thin queries opN_<name> over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ship, table

END_ID = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)
    return read_tokens(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID, 1024, {"ids_crc32": F.crc32("ids")})


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import conversation_pairs, format_preferences

    return format_preferences(*conversation_pairs(table(spark, sf_dir, "conversations")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated, digest

    return digest(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find

    return digest(find(table(spark, sf_dir, "documents"))[0])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_lm_score,
    op2_token_files,
    op3_quality,
    op4_token_counts,
    op5_embedding_links,
    op6_preference_pairs,
    op7_decontamination,
    op8_personal_data,
    op9_simhash,
    op10_packing,
]


def _sql() -> dict[str, str]:
    from . import decontam, preference

    return {"op6_preference_pairs": preference.ORACLE, "op7_decontamination": decontam.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return _sql()
