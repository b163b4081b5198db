"""Sense mining: from resolved links to groups of senses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import keep

TARGET = ["linked_article_id", "linked_section_index"]
PLACE = ["article_id", "section_index", "paragraph_index", "sentence_index"]


def see_also(sections: DataFrame, articles: DataFrame, depth: int = 3) -> DataFrame:
    """(article_id, section_index) of see-also sections on disambiguation pages and of those up to depth levels below."""
    pages = articles.where("is_disambig = 1").select(F.col("id").alias("article_id"))
    s = sections.select("article_id", "section_index", "parent_index", "title").join(pages, "article_id", "left_semi")
    level = s.where(F.lower("title") == "see also").select("article_id", "section_index")
    found = level
    for _ in range(depth):
        level = s.join(level.withColumnRenamed("section_index", "parent_index"), ["article_id", "parent_index"]).select("article_id", "section_index")
        found = found.unionByName(level)
    return found.distinct()


def disambiguation_links(links: DataFrame, articles: DataFrame, see_also_sections: DataFrame) -> DataFrame:
    """Links on disambiguation pages with the page's group title; ignored if under see-also or if their title doesn't hold the group title."""
    pages = articles.where("is_disambig = 1").select(F.col("id").alias("article_id"), F.col("group_title").alias("page_group"))
    flagged = links.join(pages, "article_id").join(see_also_sections.withColumn("s", F.lit(1)), ["article_id", "section_index"], "left")
    miss = (F.instr(F.lower("link_title"), F.col("page_group")) == 0).cast("int")
    return flagged.select("article_id", F.col("page_group").alias("group_title"), *TARGET, "link_title", F.when(F.col("s").isNotNull(), 1).otherwise(miss).alias("ignored"))


def distinct_links(links: DataFrame) -> DataFrame:
    return links.where("is_on_disambig_page = 0").select(*PLACE, *TARGET, "group_title").distinct()


def total_counts(links: DataFrame) -> DataFrame:
    """Linking sentences per target, whatever the title."""
    return links.select(*PLACE, *TARGET).distinct().groupBy(*TARGET).agg(F.count("*").alias("total"))


def matching_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("group_title", *TARGET).agg(F.count("*").alias("matching"))


def link_counts(links: DataFrame) -> DataFrame:
    """Per group title and target: sentences that link it by this title, and by others only."""
    m, t = matching_counts(links), total_counts(links)
    return m.join(t, TARGET, "left").select("group_title", *TARGET, "matching", (F.col("total") - F.col("matching")).alias("other"))


def grouped_links(counts: DataFrame, disambig_links: DataFrame, sections: DataFrame) -> DataFrame:
    """Sparse contributions of link counts, disambiguation links and paragraph counts, merged by their maximum."""
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **kw: Column) -> DataFrame:
        cols = {"is_on_disambig_page": zero, "article_paragraph_count": zero, "linked_count_matching_title": zero, "linked_count_other_title": zero} | kw
        return df.select("group_title", F.col("linked_article_id").alias("article_id"), F.col("linked_section_index").cast("bigint").alias("section_index"), *(c.cast("bigint").alias(k) for k, c in cols.items()))

    linked = part(counts, linked_count_matching_title=F.col("matching"), linked_count_other_title=F.col("other"))
    listed = part(disambig_links.where("ignored = 0"), is_on_disambig_page=F.lit(1))
    base = linked.unionByName(listed)
    keys = base.select("group_title", "article_id", "section_index").distinct()
    per_article = sections.groupBy("article_id").agg(F.sum("paragraph_count").alias("n"))
    whole = keys.where("section_index = -1").join(per_article, "article_id").selectExpr("group_title", "article_id linked_article_id", "section_index linked_section_index", "n")
    per_section = sections.select("article_id", F.col("section_index").cast("bigint").alias("section_index"), F.col("total_paragraph_count").alias("n"))
    within = keys.where("section_index >= 0").join(per_section, ["article_id", "section_index"]).selectExpr("group_title", "article_id linked_article_id", "section_index linked_section_index", "n")
    counted = part(whole.unionByName(within), article_paragraph_count=F.col("n"))
    return base.unionByName(counted).groupBy("group_title", "article_id", "section_index").agg(*(F.max(c).alias(c) for c in ("is_on_disambig_page", "article_paragraph_count", "linked_count_matching_title", "linked_count_other_title")))


MASS = "article_paragraph_count + linked_count_matching_title + linked_count_other_title"


def raw_senses(grouped: DataFrame, articles: DataFrame, least: int = 14, least_matching: int = 5) -> DataFrame:
    titles = articles.where("is_disambig = 1 and group_title is not null").select("group_title").distinct()
    enough = grouped.where(f"{MASS} >= {least} and (is_on_disambig_page = 1 or linked_count_matching_title >= {least_matching})")
    return enough.join(titles, "group_title", "left_semi").drop("is_on_disambig_page")


def dense_ids(df: DataFrame, order: list[Column], name: str = "id", parts: int | None = None) -> DataFrame:
    """0-based ids in the given total order, without one task for all rows.

    Rows are range-partitioned by the order and written down; each partition numbers its own
    and adds the sizes of those before it.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + nth - 1).cast("bigint")).drop("__p", "__before")


def ranks(df: DataFrame, by: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """1-based ranks in a total order within each group, without one task for all rows of a group: as dense_ids, with sizes by group."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(df.repartitionByRange(parts, *by, *order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order))
    return placed.withColumn("__nth", nth).join(before, [*by, "__p"]).withColumn(name, F.col("__before") + F.col("__nth")).drop("__p", "__nth", "__before")


def sense_groups(raw: DataFrame) -> DataFrame:
    return dense_ids(raw.groupBy("group_title").agg(F.sum(F.expr(MASS)).alias("mass")), [F.desc("mass"), F.asc("group_title")])


def senses(raw: DataFrame) -> DataFrame:
    return dense_ids(raw.groupBy("article_id", "section_index").agg(F.sum(F.expr(MASS)).alias("mass")), [F.desc("mass"), F.asc("article_id"), F.asc("section_index")])


def sense_group_senses(raw: DataFrame, groups: DataFrame, senses_: DataFrame) -> DataFrame:
    """The labels: pairs of group and sense by descending mass."""
    g, s = groups.select(F.col("id").alias("sense_group"), "group_title"), senses_.select(F.col("id").alias("sense"), "article_id", "section_index")
    pairs = raw.join(g, "group_title").join(s, ["article_id", "section_index"]).select("sense_group", "sense", F.expr(MASS).alias("mass"))
    return dense_ids(pairs, [F.desc("mass"), F.asc("sense_group"), F.asc("sense")])


def alternative_titles(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """Group titles of redirects to disambiguation pages, unless they lead to several groups or are groups themselves."""
    r = articles.where("redirect_article_title is not null").select(F.col("redirect_article_title").alias("title"), F.col("group_title").alias("alternative_group_title"))
    a = articles.where("is_disambig = 1").select("title", "group_title")
    found = r.join(a, "title").where("alternative_group_title <> group_title").groupBy("alternative_group_title").agg(F.min("group_title").alias("group_title"), F.countDistinct("group_title").alias("n")).where("n = 1")
    return found.join(groups.select(F.col("group_title").alias("alternative_group_title")), "alternative_group_title", "left_anti").select("group_title", "alternative_group_title")


def export_group_titles(groups: DataFrame, alternatives: DataFrame) -> DataFrame:
    main = groups.select("id", F.col("group_title").alias("title"))
    return main.unionByName(groups.join(alternatives, "group_title").select("id", F.col("alternative_group_title").alias("title")))


def possible_senses(sgs: DataFrame, ambiguous_only: bool = False) -> DataFrame:
    """The labels of each group in order."""
    out = sgs.groupBy("sense_group").agg(F.array_sort(F.collect_list("id")).alias("possible_senses"))
    return out.where(F.size("possible_senses") > 1) if ambiguous_only else out


def sense_urls(sgs: DataFrame, senses_: DataFrame, articles: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, url) of the labels; articles and sections grow with the pages and are never broadcast."""
    from ..functions import text

    s = senses_.select(F.col("id").alias("sense"), "article_id", F.col("section_index").cast("bigint").alias("section_index"))
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    x = sections.select("article_id", F.col("section_index").cast("bigint").alias("section_index"), F.col("title").alias("section_title"))
    return sgs.join(s.hint("merge"), "sense").join(a.hint("merge"), "article_id", "left").join(x.hint("merge"), ["article_id", "section_index"], "left").select("id", text.sense_url(F.col("article_title"), F.col("section_title")).alias("url"))
