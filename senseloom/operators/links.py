"""Redirects and links: from titles to articles and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import drop, keep


def resolve_redirects(redirects: DataFrame, rounds: int = 3) -> DataFrame:
    """(title, target, section): redirects(title, target, section) followed by pointer doubling.

    Each round replaces a target that is itself a redirect by the latter's target; a section
    that is already there stays, else it is inherited. Loops end with the rounds. Each round is
    written down, as the next one reads it twice, and no round is sent to the driver.
    """
    r = keep(redirects.select("title", "target", "section"))
    for _ in range(rounds):
        nxt = r.select(F.col("title").alias("target"), F.col("target").alias("t2"), F.col("section").alias("s2"))
        new = keep(r.join(nxt.hint("merge"), "target", "left").select("title", F.coalesce("t2", "target").alias("target"), F.coalesce("section", "s2").alias("section")))
        drop(r)
        r = new
    return r


def resolve(links: DataFrame, redirects: DataFrame, articles: DataFrame, section_ids: DataFrame) -> DataFrame:
    """linked_article_id and linked_section_index (-1: the whole article) for links(article_id, ..., linked_article, linked_section, link_title).

    Links to unknown titles or sections drop out. is_on_disambig_page tells of the page that the link is on.
    All tables grow with the pages, so none is broadcast, however small its files are.
    """
    moved = links.join(redirects.select(F.col("title").alias("linked_article"), "target", F.col("section").alias("rs")).hint("merge"), "linked_article", "left")
    section = F.when(F.col("target").isNotNull() & (F.coalesce("linked_section", F.lit("")) == ""), F.coalesce("rs", F.lit(""))).otherwise(F.coalesce("linked_section", F.lit("")))
    aimed = moved.withColumn("linked_section", section).withColumn("linked_article", F.coalesce("target", "linked_article")).drop("target", "rs")
    there = articles.where("redirect_article_title is null").select(F.col("title").alias("linked_article"), F.col("id").alias("linked_article_id"))
    sections = section_ids.select(F.col("article_id").alias("linked_article_id"), F.col("id_string").alias("linked_section"), F.col("section_index").alias("at"))
    found = aimed.join(there.hint("merge"), "linked_article").join(sections.hint("merge"), ["linked_article_id", "linked_section"], "left").where("linked_section = '' or at is not null")
    on = articles.where("is_disambig = 1").select(F.col("id").alias("article_id"), F.lit(1).alias("f"))
    flagged = found.withColumn("linked_section_index", F.when(F.col("linked_section") == "", F.lit(-1)).otherwise(F.col("at"))).join(on.hint("merge"), "article_id", "left")
    return flagged.withColumn("is_on_disambig_page", F.coalesce("f", F.lit(0))).drop("f", "at", "linked_section")


def sentence_of(begin, ends):
    """Index of the first sentence that ends after begin, given the array of ends."""
    return F.size(F.filter(ends, lambda e: e <= begin))
