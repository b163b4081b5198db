"""Sections of articles: counts, roll-up over the hierarchy, parents by heading level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import keep


def with_counts(sections: DataFrame, paragraph_counts: DataFrame) -> DataFrame:
    """sections with paragraph_count, 0 where none were kept."""
    return sections.join(paragraph_counts, ["article_id", "section_index"], "left").withColumn("paragraph_count", F.coalesce("paragraph_count", F.lit(0).cast("bigint")))


def most_sections(sections: DataFrame) -> int:
    """Sections of the article that has the most: no hierarchy of an article is deeper."""
    return sections.groupBy("article_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def rollup(sections: DataFrame) -> DataFrame:
    """total_paragraph_count: the count of a section and of all below it, however deep; sections that are below themselves are an error.

    Counts rise one level a round, already added up by parent, so a round moves no more
    rows than there are inner sections; it ends when nothing rises.
    """
    parent = sections.select("article_id", F.col("section_index").alias("at"), "parent_index")
    rising = sections.where("parent_index is not null").select("article_id", F.col("parent_index").alias("at"), F.col("paragraph_count").alias("n"))
    gains, deepest = [], most_sections(sections)
    while True:
        rising = keep(rising.groupBy("article_id", "at").agg(F.sum("n").alias("n")))
        if rising.isEmpty():
            break
        if len(gains) >= deepest:
            raise ValueError("sections form a cycle")
        gains.append(rising)
        rising = rising.join(parent, ["article_id", "at"]).where("parent_index is not null").select("article_id", F.col("parent_index").alias("at"), "n")
    total = sections.select("article_id", F.col("section_index").alias("at"), F.col("paragraph_count").alias("n"))
    for g in gains:
        total = total.unionByName(g)
    sums = total.groupBy("article_id", F.col("at").alias("section_index")).agg(F.sum("n").alias("total_paragraph_count"))
    return sections.join(sums, ["article_id", "section_index"])


def parents(headings: DataFrame) -> DataFrame:
    """parent_index from (article_id, section_index, level): the nearest earlier section of a smaller level; a lead without a level has 2."""
    h = F.struct("section_index", F.coalesce("level", F.lit(2)).alias("level"))
    own = headings.groupBy("article_id").agg(F.array_sort(F.collect_list(h)).alias("hs"))
    found = "transform(hs, x -> struct(x.section_index, x.level, array_max(transform(filter(hs, y -> y.section_index < x.section_index and y.level < x.level), y -> y.section_index)) as parent_index))"
    return own.selectExpr("article_id", f"inline({found})")
