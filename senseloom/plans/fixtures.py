"""Mining inputs made from the star-schema tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import sections as sec
from ..operators import senses as sen
from ..operators.keep import keep


class Inputs:
    """Tables of a directory and the views on them; each view is made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            f = getattr(type(self), f"make_{name}", None)
            self.made[name] = f(self) if f else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def sql(self, q: str, **dfs: DataFrame) -> DataFrame:
        return self.spark.sql(q, **dfs)

    def make_articles(self) -> DataFrame:
        """Pages; joins with tables of their size are merged, as the files of these are much smaller than their rows."""
        t = "concat(if({a}.p_partkey % 7 = 3, concat('Variant_', {a}.p_partkey % 97, '_'), ''), translate({a}.p_name, ' ', '_'), '_(', {a}.p_partkey, ')')"
        return self.sql(
            f"""select p.p_partkey id, {t.format(a='p')} title, case when p.p_partkey % 7 = 3 then {t.format(a='q')} end redirect_article_title,
                cast(p.p_partkey % 10 = 0 and p.p_partkey % 7 <> 3 as int) is_disambig
                from {{part}} p join {{other}} q on q.p_partkey = (p.p_partkey * 13 + 5) % (select count(*) from {{part}})""",
            part=self.part, other=self.part.hint("merge"),
        ).withColumn("group_title", text.group_title(F.col("title")))

    def make_raw_sections(self) -> DataFrame:
        s = self.part.select(F.col("p_partkey").alias("article_id"), F.explode(F.expr("sequence(0L, 6L)")).alias("section_index"))
        return s.selectExpr("article_id", "section_index", "if(section_index = 0, null, (section_index - 1) div 2) parent_index", "if(section_index = 1, 'See also', concat('Section ', section_index)) title")

    def make_w_links(self) -> DataFrame:
        return self.sql(
            """select l_orderkey % (select count(*) from {part}) article_id, cast(l_linenumber - 1 as bigint) section_index, cast(floor(l_quantity) as bigint) % 5 paragraph_index,
               l_suppkey % 3 sentence_index, l_partkey linked_article_id, cast(if(l_suppkey % 4 = 0, l_partkey % 7, -1) as bigint) linked_section_index, if(l_returnflag = 'R', p_brand, p_name) link_title,
               lower(if(l_returnflag = 'R', p_brand, p_name)) group_title
               from {lineitem} join {named} on l_partkey = p_partkey""",
            part=self.part, named=self.part.hint("merge"), lineitem=self.lineitem,
        )

    def make_links(self) -> DataFrame:
        on = self.articles.where("is_disambig = 1").select(F.col("id").alias("article_id"), F.lit(1).alias("f"))
        return self.w_links.join(on.hint("merge"), "article_id", "left").withColumn("is_on_disambig_page", F.coalesce("f", F.lit(0))).drop("f")

    def make_unresolved_links(self) -> DataFrame:
        """Links by title, of which some lead nowhere and some to a section."""
        a = self.articles.select(F.col("id").alias("l_partkey"), "title")
        li = self.lineitem.join(a.hint("merge"), "l_partkey")
        n = self.part.count()
        title = F.concat("title", F.when(F.col("l_suppkey") % 11 == 0, "_missing").otherwise(""))
        section = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("Section_"), F.col("l_linenumber").cast("string"))).otherwise("")
        return li.select((F.col("l_orderkey") % n).alias("article_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("section_index"), title.alias("linked_article"), section.alias("linked_section"), F.lower("title").alias("link_title"))

    def make_section_ids(self) -> DataFrame:
        return self.raw_sections.select("article_id", "section_index", F.translate("title", " ", "_").alias("id_string"))

    def make_redirects(self) -> DataFrame:
        return self.articles.where("redirect_article_title is not null").select("title", F.col("redirect_article_title").alias("target"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Section_"), (F.col("id") % 9).cast("string"))).alias("section"))

    def make_paragraph_counts(self) -> DataFrame:
        d = self.lineitem.select((F.col("l_orderkey") % self.part.count()).alias("article_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("section_index"), (F.floor("l_quantity") % 5).alias("p")).distinct()
        return d.groupBy("article_id", "section_index").agg(F.count("*").alias("paragraph_count"))

    def make_sections(self) -> DataFrame:
        return keep(sec.rollup(keep(sec.with_counts(self.raw_sections, self.paragraph_counts))))

    def make_see_also(self) -> DataFrame:
        return sen.see_also(self.raw_sections, self.articles)

    def make_disambig_links(self) -> DataFrame:
        return keep(sen.disambiguation_links(self.w_links, self.articles, self.see_also))

    def make_distinct_links(self) -> DataFrame:
        return keep(sen.distinct_links(self.links))

    def make_link_counts(self) -> DataFrame:
        return keep(sen.link_counts(self.distinct_links))

    def make_grouped(self) -> DataFrame:
        return sen.grouped_links(self.link_counts, self.disambig_links, self.sections)

    def make_raw_senses(self) -> DataFrame:
        return keep(sen.raw_senses(self.grouped, self.articles))

    def make_groups(self) -> DataFrame:
        return keep(sen.sense_groups(self.raw_senses))

    def make_senses(self) -> DataFrame:
        return keep(sen.senses(self.raw_senses))

    def make_sgs(self) -> DataFrame:
        return keep(sen.sense_group_senses(self.raw_senses, self.groups, self.senses))

    def make_alternatives(self) -> DataFrame:
        return sen.alternative_titles(self.articles, self.groups)


_T3 = r"regexp_replace(regexp_replace(lower(replace({}, '_', ' ')), '^(.*) \(.*?\)$', '\1'), '^(?:a|an|the) (.*)$', '\1')"
T3 = _T3.format
T2 = "replace(replace(url_encode(replace({}, ' ', '_')), '%3A', ':'), '%', '.')".format
MASS = "article_paragraph_count + linked_count_matching_title + linked_count_other_title"

_NAME = "(case when {0}.p_partkey % 7 = 3 then 'Variant_' || ({0}.p_partkey % 97) || '_' else '' end || replace({0}.p_name, ' ', '_') || '_(' || {0}.p_partkey || ')')".format

#: Views as SQL; each may use those before it.
VIEWS: dict[str, str] = {
    "cnt": "select count(*) n from part",
    "articles": f"""select p.p_partkey id, {_NAME('p')} title, case when p.p_partkey % 7 = 3 then {_NAME('q')} end redirect_article_title,
        (p.p_partkey % 10 = 0 and p.p_partkey % 7 <> 3)::int is_disambig, {T3(_NAME('p'))} group_title
        from part p, cnt, part q where q.p_partkey = (p.p_partkey * 13 + 5) % n""",
    "raw_sections": "select p_partkey article_id, s section_index, case when s > 0 then (s - 1) // 2 end parent_index, case when s = 1 then 'See also' else 'Section ' || s end title from part, range(7) t(s)",
    "w_links": """select l_orderkey % n article_id, (l_linenumber - 1)::bigint section_index, floor(l_quantity)::bigint % 5 paragraph_index, l_suppkey % 3 sentence_index, l_partkey linked_article_id,
        (case when l_suppkey % 4 = 0 then l_partkey % 7 else -1 end)::bigint linked_section_index, case when l_returnflag = 'R' then p_brand else p_name end link_title, lower(case when l_returnflag = 'R' then p_brand else p_name end) group_title
        from lineitem join part on l_partkey = p_partkey, cnt""",
    "links": "select w.*, a.is_disambig is_on_disambig_page from w_links w join articles a on a.id = w.article_id",
    "unresolved": """select l_orderkey % n article_id, (l_linenumber - 1)::bigint section_index, title || case when l_suppkey % 11 = 0 then '_missing' else '' end linked_article,
        case when l_suppkey % 5 = 0 then 'Section_' || l_linenumber else '' end linked_section, lower(title) link_title from lineitem join articles on l_partkey = id, cnt""",
    "section_ids": "select article_id, section_index, replace(title, ' ', '_') id_string from raw_sections",
    "redirects": "select title, redirect_article_title target, case when id % 2 = 0 then 'Section_' || (id % 9) end section from articles where redirect_article_title is not null",
    "r1": "select a.title, coalesce(b.target, a.target) target, coalesce(a.section, b.section) section from redirects a left join redirects b on b.title = a.target",
    "r2": "select a.title, coalesce(b.target, a.target) target, coalesce(a.section, b.section) section from r1 a left join r1 b on b.title = a.target",
    "r3": "select a.title, coalesce(b.target, a.target) target, coalesce(a.section, b.section) section from r2 a left join r2 b on b.title = a.target",
    "paragraph_counts": "select article_id, section_index, count(distinct paragraph_index) paragraph_count from w_links group by 1, 2",
    "counted": "select s.*, coalesce(paragraph_count, 0) paragraph_count from raw_sections s left join paragraph_counts using (article_id, section_index)",
    "up": "select article_id, section_index, section_index at_index, paragraph_count, parent_index p from counted union all select u.article_id, u.section_index, s.section_index, u.paragraph_count, s.parent_index from up u join raw_sections s on s.article_id = u.article_id and s.section_index = u.p",
    "sections": "select c.*, t.total_paragraph_count from counted c join (select article_id, at_index section_index, sum(paragraph_count)::bigint total_paragraph_count from up group by 1, 2) t using (article_id, section_index)",
    "see_also": """select distinct s.article_id, s.section_index from raw_sections s join articles a on a.id = s.article_id and is_disambig = 1
        left join raw_sections p1 on p1.article_id = s.article_id and p1.section_index = s.parent_index left join raw_sections p2 on p2.article_id = s.article_id and p2.section_index = p1.parent_index
        left join raw_sections p3 on p3.article_id = s.article_id and p3.section_index = p2.parent_index
        where 'see also' in (lower(s.title), lower(p1.title), lower(p2.title), lower(p3.title))""",
    "disambig_links": """select l.article_id, a.group_title, l.linked_article_id, l.linked_section_index, l.link_title,
        case when s.section_index is not null then 1 when instr(lower(l.link_title), a.group_title) = 0 then 1 else 0 end ignored
        from w_links l join articles a on a.id = l.article_id and is_disambig = 1 left join see_also s on s.article_id = l.article_id and s.section_index = l.section_index""",
    "distinct_links": "select distinct article_id, section_index, paragraph_index, sentence_index, linked_article_id, linked_section_index, group_title from links where is_on_disambig_page = 0",
    "total_counts": "select linked_article_id, linked_section_index, count(*) total from (select distinct article_id, section_index, paragraph_index, sentence_index, linked_article_id, linked_section_index from distinct_links) group by 1, 2",
    "matching_counts": "select group_title, linked_article_id, linked_section_index, count(*) matching from distinct_links group by 1, 2, 3",
    "link_counts": "select group_title, linked_article_id, linked_section_index, matching, total - matching other from matching_counts left join total_counts using (linked_article_id, linked_section_index)",
    "base": """select group_title, linked_article_id article_id, linked_section_index section_index, 0 d, 0 p, matching m, other o from link_counts
        union all select distinct group_title, linked_article_id, linked_section_index, 1, 0, 0, 0 from disambig_links where ignored = 0""",
    "contributions": """select * from base union all
        select k.*, 0, c.n, 0, 0 from (select distinct group_title, article_id, section_index from base where section_index = -1) k join (select article_id, sum(paragraph_count) n from sections group by 1) c using (article_id)
        union all select k.*, 0, s.total_paragraph_count, 0, 0 from (select distinct group_title, article_id, section_index from base where section_index >= 0) k join sections s using (article_id, section_index)""",
    "grouped": """select group_title, article_id, section_index, max(d)::bigint is_on_disambig_page, max(p)::bigint article_paragraph_count, max(m)::bigint linked_count_matching_title,
        max(o)::bigint linked_count_other_title from contributions group by 1, 2, 3""",
    "raw_senses": f"""select group_title, article_id, section_index, article_paragraph_count, linked_count_matching_title, linked_count_other_title from grouped
        where group_title in (select group_title from articles where is_disambig = 1) and {MASS} >= 14 and (is_on_disambig_page = 1 or linked_count_matching_title >= 5)""",
    "groups": f"select group_title, sum({MASS})::bigint mass, row_number() over (order by sum({MASS}) desc, group_title) - 1 id from raw_senses group by 1",
    "senses": f"select article_id, section_index, sum({MASS})::bigint mass, row_number() over (order by sum({MASS}) desc, article_id, section_index) - 1 id from raw_senses group by 1, 2",
    "sgs": f"""select g.id sense_group, s.id sense, {MASS} mass, row_number() over (order by {MASS} desc, g.id, s.id) - 1 id
        from raw_senses r join groups g using (group_title) join senses s on s.article_id = r.article_id and s.section_index = r.section_index""",
    "alternatives": """select min(a.group_title) group_title, r.group_title alternative_group_title from articles r join articles a on r.redirect_article_title = a.title and a.is_disambig = 1 and r.group_title <> a.group_title
        where r.group_title not in (select group_title from groups) group by r.group_title having count(distinct a.group_title) = 1""",
    "labels_of": "select sgs.id \"label\", article_id, section_index from sgs join senses s on s.id = sgs.sense",
    "link_examples": """select distinct l.article_id, l.section_index, l.paragraph_index, l.sentence_index, x."label" from links l join labels_of x on x.article_id = l.linked_article_id and x.section_index = l.linked_section_index
        where is_on_disambig_page = 0""",
    "below": """select "label", article_id, section_index from labels_of where section_index >= 0
        union all select b."label", b.article_id, s.section_index from below b join raw_sections s on s.article_id = b.article_id and s.parent_index = b.section_index""",
    "down": """select "label", x.article_id, s.section_index, s.paragraph_count from labels_of x join counted s on s.article_id = x.article_id and x.section_index = -1
        union all select "label", b.article_id, b.section_index, s.paragraph_count from below b join counted s on s.article_id = b.article_id and s.section_index = b.section_index""",
    "paragraph_examples": "select article_id, section_index, unnest(range(0, paragraph_count)) paragraph_index, null::bigint sentence_index, \"label\" from down",
    "keyed": "select *, md5(article_id || ':' || section_index || ':' || paragraph_index || ':' || coalesce(sentence_index, -1)) k from link_examples",
    "quotas": "select \"label\", round_even(count(*) * 0.15, 0)::bigint q from link_examples group by 1",
    "owners": "select k, max(\"label\") owner from keyed group by 1",
    "split": """select article_id, section_index, paragraph_index, sentence_index, "label", case when rn <= q then 1 when rn <= 2 * q then 2 else 0 end dataset
        from keyed join (select k, q, row_number() over (partition by owner order by k) rn from owners join quotas on "label" = owner) using (k)""",
}


def with_views(query: str, *names: str) -> str:
    """The query behind the named views and those that they use, each evaluated once."""
    import re

    wanted, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += [w for w in set(re.findall(r"\w+", VIEWS[n])) if w in VIEWS and w != n]
    todo = [w for w in set(re.findall(r"\w+", query)) if w in VIEWS]
    for n in todo:
        if n not in wanted:
            wanted |= {n}
            todo += [w for w in set(re.findall(r"\w+", VIEWS[n])) if w in VIEWS and w != n]
    return "with recursive " + ",\n".join(f"{n} as {'' if n in ('up', 'below') else 'materialized '}({VIEWS[n]})" for n in VIEWS if n in wanted) + "\n" + query
