"""Category graph: links by title, closure below a root, disambiguation flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import keep


def resolve_links(category_links: DataFrame, categories: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subcategories, article_categories) from links(from_id, title, type); unknown targets and articles drop out."""
    known = category_links.where(F.col("type").isin("page", "subcat")).join(categories.select(F.col("id").alias("category_id"), "title"), "title")
    sub = known.where("type = 'subcat'").select("category_id", F.col("from_id").alias("subcategory_id"))
    pages = known.where("type = 'page'").join(articles.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return sub, pages.select(F.col("from_id").alias("article_id"), "category_id")


def closure(subcategories: DataFrame, roots: DataFrame) -> DataFrame:
    """category_id of the roots and all below them, however deep; cycles end, as only new categories go on."""
    seen = frontier = keep(roots.select("category_id").distinct())
    edges = keep(subcategories.select("category_id", "subcategory_id").distinct())
    while True:
        frontier = keep(edges.join(frontier, "category_id").select(F.col("subcategory_id").alias("category_id")).distinct().join(seen, "category_id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def flag_disambiguation(articles: DataFrame, article_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """articles with is_disambig 1 where one of their categories is among the given ones, else 0."""
    hit = article_categories.join(categories, "category_id", "left_semi").select(F.col("article_id").alias("id")).distinct().withColumn("f", F.lit(1))
    return articles.drop("is_disambig").join(hit, "id", "left").withColumn("is_disambig", F.coalesce("f", F.lit(0))).drop("f")
