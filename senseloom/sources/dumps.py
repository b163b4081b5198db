"""Readers and writers of dump files: pages in XML, SQL dumps, tab-separated tables, descriptors and jobs."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text

PAGE = (
    "title string, ns int, id long, redirect struct<_title: string>, "
    "revision array<struct<id: long, parentid: long, timestamp: string, contributor: struct<username: string, id: string, ip: string>, minor: string, comment: string, "
    "text: struct<_VALUE: string, _bytes: long>, sha1: string, model: string, format: string>>"
)


def read_pages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of <page>; compressed dumps are split where their format allows. strict: a row that doesn't fit the schema fails."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("mode", mode).schema(PAGE).load(path)


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def articles(pages: DataFrame, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    """(id, title, group_title, text, redirect_article_title, redirect_section_id) of pages in the namespaces, by their first revision.

    In namespace 0 only wikitext counts. A redirect is a text that begins with it; its target is split at the first #.
    """
    p = pages.where(F.col("ns").isin(*namespaces)).select("id", "ns", "title", F.element_at("revision", 1).alias("r"))
    p = p.where("ns <> 0 or (r.model = 'wikitext' and r.format = 'text/x-wiki')").select("id", "title", F.col("r.text._VALUE").alias("text"))
    target = F.regexp_extract("text", r"(?i)^\s*#REDIRECT\s*:?\s*\[\[([^\]|]*)", 1)
    t = p.withColumn("target", F.when(F.coalesce(target, F.lit("")) != "", pandas_udf(_unescape, "string")(target)))
    parts = F.split("target", "#", 2)
    return t.select(
        "id", text.page_title(F.col("title")).alias("title"), text.group_title(F.col("title")).alias("group_title"), "text",
        text.page_title(parts[0]).alias("redirect_article_title"), text.section_anchor(F.get(parts, F.lit(1))).alias("redirect_section_id"),
    )


_STR = r"'((?:[^'\\]|\\.)*)'"


def sql_rows(lines: DataFrame, table: str, fields: str, names: list[str]) -> DataFrame:
    """Rows of the INSERT lines of a table in a dump, by a regular expression with one group a field, all as strings."""
    mine = lines.where(F.col("value").startswith(f"INSERT INTO `{table}` VALUES "))
    groups = [F.regexp_extract_all("value", F.lit(fields), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    return mine.select(*groups).select(F.inline(F.arrays_zip(*names)))


def page_table(lines: DataFrame, namespace: int = 14) -> DataFrame:
    """(id, title) of a namespace from a dump of the page table."""
    rows = sql_rows(lines, "page", rf"\((\d+),(-?\d+),{_STR},", ["id", "ns", "title"])
    return rows.where(F.col("ns").cast("int") == namespace).select(F.col("id").cast("long").alias("id"), text.unescape_sql(F.col("title")).alias("title"))


def category_links(lines: DataFrame) -> DataFrame:
    """(from_id, title, type) from a dump of the categorylinks table."""
    rows = sql_rows(lines, "categorylinks", rf"\((\d+),{_STR},{_STR},{_STR},{_STR},{_STR},{_STR}\)", ["from_id", "title", "k", "t", "p", "c", "type"])
    return rows.select(F.col("from_id").cast("long").alias("from_id"), text.unescape_sql(F.col("title")).alias("title"), "type")


LINKS = "article_id long, section_index long, paragraph_index long, sentence_index long, begin long, end long, linked_article string, linked_section string, link_title string"
TOKENS = "article_id long, section_index long, paragraph_index long, sentence_index long, begin long, end long, value string, pos string, lemma string, before string, after string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("emptyValue", "").option("nullValue", "\x00").csv(path)


def write_tsv(df: DataFrame, path: str, parts: int | None = None, key: str = "article_id") -> None:
    """Gzipped columns without tabs and newlines, null as empty; parts: files by the key's hash."""
    df = df.repartition(parts, key) if parts else df
    df.select(*(text.tsv_safe(F.col(c)).alias(c) for c in df.columns)).write.option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").option("compression", "gzip").csv(path)


def sentences(tokens: DataFrame) -> DataFrame:
    """(place, sentence_index, tokens) from rows of a token file."""
    key = ["article_id", "section_index", "paragraph_index", "sentence_index"]
    t = F.struct("begin", "end", "value", "pos", "lemma", "before", "after")
    return tokens.groupBy(*key).agg(F.array_sort(F.collect_list(t)).alias("tokens"))


def sentence_gaps(sentences: DataFrame) -> DataFrame:
    """(place, n, first, last) of paragraphs whose sentence indexes aren't 0, 1, ... without gaps; of sound token files there are none."""
    key = ["article_id", "section_index", "paragraph_index"]
    by = sentences.groupBy(*key).agg(F.countDistinct("sentence_index").alias("n"), F.min("sentence_index").alias("first"), F.max("sentence_index").alias("last"))
    return by.where("first <> 0 or last <> n - 1")


@dataclass(frozen=True)
class Descriptor:
    """How examples are made from tokens."""

    n_gram_size: int = 1
    caseless: bool = True
    ignore_punctuation: bool = True
    add_pos_tags: bool = False
    uses_lemma: bool = False
    uses_sentences: bool = False

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> Descriptor:
        with open(path) as f:
            x = json.load(f)
        return cls(**{k: type(getattr(cls, k))(x[k]) for k in asdict(cls())})

    @classmethod
    def of(cls, option: str) -> tuple[str, Descriptor]:
        """From name,n[,c][,p][,pos][,lemma][,sent]."""
        name, n, *flags = option.split(",")
        if extra := set(flags) - {"c", "p", "pos", "lemma", "sent"}:
            raise ValueError(f"unknown options: {sorted(extra)}")
        return name, cls(int(n), "c" in flags, "p" in flags, "pos" in flags, "lemma" in flags, "sent" in flags)


@dataclass(frozen=True)
class Job:
    dataset_name: str
    model_name: str
    params: dict = field(default_factory=dict)
    batch_size: int = 32
    epochs: int | None = None
    target: dict | None = None
    train_sets: tuple[str, ...] = ("train",)
    test_sets: tuple[str, ...] = ("dev", "test")


def load_jobs(path: str) -> list[Job]:
    with open(path) as f:
        return [Job(**{k: tuple(v) if k.endswith("_sets") else v for k, v in x.items()}) for x in json.load(f)]
