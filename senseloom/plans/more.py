"""Queries over files, streams and models."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import examples as exa
from ..operators import infer, train
from ..operators.keep import folder, keep
from ..sources import dumps, wikitext
from ..streaming import disambiguate as live
from .fixtures import Inputs, with_views
from .registry import DISAMBIGUATE, LOADED, SIZE, _link_examples, features, out_layer, phrases, query, score, urls, vectors, wanted


@query(DISAMBIGUATE)
def stream_disambiguate(i: Inputs) -> DataFrame:
    """The rows of disambiguate, from a stream of the documents' files."""
    spark, source = i.spark, f"{i.sf_dir}/documents.parquet"
    at = folder(spark)
    one_file = os.path.isfile(source)
    reader = spark.readStream.schema(i.documents.schema).option("maxFilesPerTrigger", 4)
    stream = reader.option("pathGlobFilter", "documents.parquet").parquet(i.sf_dir) if one_file else reader.parquet(source)
    ph = keep(phrases(i))
    best = keep(infer.best_named(ph.select("phrase", "label"), score, urls(i, ph)))  # once, not for every batch

    def answer(batch: DataFrame) -> DataFrame:
        return infer.name_spans(infer.text_spans(batch, ["doc_id"], 2), ["doc_id"], best)

    live.run(stream, answer, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("select p_partkey id, p_name || '''s' title from part where p_partkey % 3 = 0")
def sql_dump_scan(i: Inputs) -> DataFrame:
    p = i.part.select(F.expr("concat('(', p_partkey, ',', if(p_partkey % 3 = 0, 14, 0), ',\\'', p_name, '\\\\\\'s\\',0.5)')").alias("v"), F.expr("p_partkey div 50 k"))
    lines = p.groupBy("k").agg(F.array_join(F.collect_list("v"), ",").alias("v")).select(F.concat(F.lit("INSERT INTO `page` VALUES "), "v", F.lit(";")).alias("value"))
    at = folder(i.spark)
    lines.write.option("compression", "gzip").text(at)
    return dumps.page_table(i.spark.read.text(at))


@query("""select l_orderkey article_id, l_linenumber section_index, 1 paragraph_index, l_suppkey % 3 sentence_index, 2 begin, 2 + len(p_name) "end", replace(p_name, ' ', '_') linked_article,
case when l_suppkey % 2 = 0 then 'The_part' end linked_section, p_name link_title from lineitem join part on p_partkey = l_partkey""")
def links_tsv(i: Inputs) -> DataFrame:
    """Links through a tab-separated table."""
    n = lambda c: F.expr(c).cast("long")
    t = i.lineitem.join(i.part, i.lineitem.l_partkey == i.part.p_partkey).select(
        F.col("l_orderkey").alias("article_id"), n("l_linenumber").alias("section_index"), n("1").alias("paragraph_index"), n("l_suppkey % 3").alias("sentence_index"), n("2").alias("begin"), n("2 + length(p_name)").alias("end"),
        F.translate("p_name", " ", "_").alias("linked_article"), F.expr("if(l_suppkey % 2 = 0, 'The_part', null)").alias("linked_section"), F.col("p_name").alias("link_title"),
    )
    at = folder(i.spark)
    dumps.write_tsv(t, at)
    return dumps.read_tsv(i.spark, at, dumps.LINKS).withColumn("linked_section", F.nullif("linked_section", F.lit("")))


@query("select l_orderkey article_id, count(distinct l_suppkey % 3) n, min(l_suppkey % 3) first, max(l_suppkey % 3) last from lineitem group by 1 having min(l_suppkey % 3) <> 0 or max(l_suppkey % 3) <> count(distinct l_suppkey % 3) - 1")
def sentence_gaps(i: Inputs) -> DataFrame:
    return dumps.sentence_gaps(i.lineitem.selectExpr("l_orderkey article_id", "0L section_index", "0L paragraph_index", "l_suppkey % 3 sentence_index")).drop("section_index", "paragraph_index")


@query("""with w as (select doc_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) n from documents),
ex as (select distinct l_orderkey, l_partkey % 10 "label" from lineitem)
select doc_id article_id, "label" sense, n n_tokens, "label" % 3 dataset from ex join w on doc_id = l_orderkey where n > 0 and "label" <> 9""")
def example_files(i: Inputs) -> DataFrame:
    """Examples through files by dataset; those without tokens or candidates are left out."""
    w = i.documents.selectExpr("doc_id article_id", "filter(split(coalesce(text, ''), ' '), x -> x <> '') tokens")
    ex = i.lineitem.selectExpr("l_orderkey article_id", "l_partkey % 10 sense").distinct()
    rows = ex.join(w, "article_id").selectExpr("article_id", "sense", "tokens", "if(sense = 9, array(), array(sense, (sense + 1) % 10)) possible_senses", "sense % 3 dataset")
    at = folder(i.spark)
    exa.write_examples(rows, at)
    return exa.read_examples(i.spark, at).selectExpr("article_id", "sense", "cast(size(tokens) as bigint) n_tokens", "cast(dataset as bigint) dataset")


_MOVED = "page_id % 6 = 0"


@query(rf"""select page_id id, upper(url[1]) || replace(url[2:], ' ', '_') title, md5(case when {_MOVED} then '#REDIRECT [[other ' || page_id || '#The section|x]]' else html end) digest,
case when {_MOVED} then 'Other_' || page_id end redirect_article_title, case when {_MOVED} then 'The_section' end redirect_section_id from pages where page_id % 4 <> 1 and page_id % 5 <> 2""")
def xml_pages(i: Inputs) -> DataFrame:
    """Pages of two namespaces and two content models, some of them redirects, through a dump in XML."""
    moved = f"if({_MOVED}, concat('#REDIRECT [[other ', page_id, '#The section|x]]'), html)"
    r = F.struct(F.col("page_id").alias("id"), F.struct(F.expr(moved).alias("_VALUE")).alias("text"), F.expr("if(page_id % 5 = 2, 'json', 'wikitext')").alias("model"), F.lit("text/x-wiki").alias("format"))
    rows = i.pages.select(F.col("url").alias("title"), F.expr("cast(page_id % 4 = 1 as int)").alias("ns"), F.col("page_id").alias("id"), F.array(r).alias("revision"))
    at = folder(i.spark)
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(at)
    return dumps.articles(dumps.read_pages(i.spark, at)).select("id", "title", F.md5("text").alias("digest"), "redirect_article_title", "redirect_section_id")


_PAGE = "concat('The ', p_name, ' is a [[', p_brand, '|useful thing]] that many people use every day.\\n\\n== Other ==\\n\\nIt is often seen with [[other page#The part|other things]] of ', p_partkey, ' kinds.\\n\\nshort.\\n')"


def _simple_pages(i: Inputs) -> DataFrame:
    return wikitext.parse_pages(i.part.select(F.col("p_partkey").alias("id"), F.expr(_PAGE).alias("text")))


@query("""select p_partkey article_id, 0 section_index, 0 paragraph_index, 'The ' || p_name || ' is a useful thing that many people use every day.' "text" from part
union all select p_partkey, 1, 0, 'It is often seen with other things of ' || p_partkey || ' kinds.' from part""")
def wikitext_paragraphs(i: Inputs) -> DataFrame:
    """Paragraphs of pages in simple markup; those that are too short are left out."""
    p = wikitext.shred(_simple_pages(i))["paragraphs"]
    return p.select("article_id", F.col("section_index").cast("int").alias("section_index"), F.col("paragraph_index").cast("int").alias("paragraph_index"), "text")


@query("""select p_partkey article_id, 0 section_index, len('The ' || p_name || ' is a ')::int start, len('The ' || p_name || ' is a useful thing')::int "end", 'useful thing' link_title, string_split(p_brand, '#')[1] linked_article, string_split(p_brand, '#')[2] linked_section from part
union all select p_partkey, 1, 22, 34, 'other things', 'Other_page', 'The_part' from part""")
def wikitext_links(i: Inputs) -> DataFrame:
    links = wikitext.shred(_simple_pages(i))["links"]
    return links.select("article_id", "section_index", "start", "end", "link_title", "linked_article", F.coalesce("linked_section", F.lit("")).alias("linked_section"))


@query("select count(*) n_pages, (2 * count(*))::bigint n_paragraphs, count(*) n_skipped, count(*) n_pages_with_skips from part")
def skip_counters(i: Inputs) -> DataFrame:
    return wikitext.counters(_simple_pages(i))


@query()
def wikitext_parse(i: Inputs) -> DataFrame:
    parsed = wikitext.parse_pages(i.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text")))
    return wikitext.shred(parsed)["paragraphs"]


@query("select l_orderkey article_id, l_linenumber section_index, l_linestatus || ' ' || l_partkey \"value\", l_returnflag pos from lineitem")
def tsv_round_trip(i: Inputs) -> DataFrame:
    zero = F.lit(0).cast("long")
    t = i.lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("long").alias("section_index"), zero.alias("paragraph_index"), zero.alias("sentence_index"), zero.alias("begin"), zero.alias("end"), F.concat_ws("\t", "l_linestatus", F.col("l_partkey").cast("string")).alias("value"), F.col("l_returnflag").alias("pos"), *(F.lit(None).cast("string").alias(c) for c in ("lemma", "before", "after")))
    at = folder(i.spark)
    dumps.write_tsv(t, at, 4)
    return dumps.read_tsv(i.spark, at, dumps.TOKENS).select("article_id", "section_index", "value", "pos")


@query("select conv_id id, count(*) n_tokens, sum(turn)::bigint starts, string_agg(role, ',' order by role) roles from conversations group by 1")
def rest_requests(i: Inputs) -> DataFrame:
    t = F.array(F.col("turn").cast("string"), (F.col("turn") + 1).cast("string"), "role", F.lit(None).cast("string"), F.lit(""), F.lit(""))
    bodies = i.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.array(F.array_sort(F.collect_list(t))).alias("paragraphs"))).alias("body")).select(F.col("conv_id").alias("id"), "body")
    return live.requests(bodies).groupBy("id").agg(F.count("*").alias("n_tokens"), F.sum("start").alias("starts"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("roles"))


@query(with_views("""select article_id, section_index, paragraph_index, sentence_index, "label", case when rn <= q then 1 when rn <= 2 * q then 2 else 0 end dataset
from (select *, row_number() over (partition by "label" order by k) rn, round_even(count(*) over (partition by "label") * 0.15, 0) q
      from (select article_id, section_index, paragraph_index, sentence_index, max("label") "label", any_value(k) k from keyed group by 1, 2, 3, 4))""", "keyed"))
def split_greedy_single(i: Inputs) -> DataFrame:
    """The greedy division where each place has one label, its largest."""
    e = keep(_link_examples(i).groupBy("article_id", "section_index", "paragraph_index", "sentence_index").agg(F.max("label").alias("label")))
    return exa.split_greedy(e, exa.label_components(e))


@query()
def split_greedy(i: Inputs) -> DataFrame:
    e = keep(_link_examples(i))
    return exa.split_greedy(e, exa.label_components(e))


@query(LOADED)
def loaded_model(i: Inputs) -> DataFrame:
    """Logits by the tables of a saved model, read back and joined."""
    at = folder(i.spark)
    vectors(i).write.parquet(f"{at}/embeddings")
    out_layer(i).write.parquet(f"{at}/out_layer")
    e, o = train.load_tables(i.spark, at)
    found = infer.logits(infer.pool(features(i), e, ["doc_id"], SIZE), wanted(i), o, ["doc_id"])
    return found.select("doc_id", "label", F.round("logit", 6).alias("logit"))


@query()
def train_model(i: Inputs) -> DataFrame:
    """Predictions of a language classifier for all documents; it is trained on those whose crc32(doc_id as text) is even, the others are held out."""
    lang = F.expr("array_position(array('de', 'en', 'es', 'fr'), lang) - 1")
    held = (F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 2 == 1).alias("held_out")
    e = i.documents.select("doc_id", held, F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("tokens"), F.expr("array(0L, 1L, 2L, 3L)").alias("possible_senses"), lang.alias("sense"))
    model, _ = train.train(e.where("not held_out and sense >= 0"), train.Params(buckets=1 << 14, rate=0.5), 2)
    return train.predict(e, model, ["doc_id", "held_out"])
