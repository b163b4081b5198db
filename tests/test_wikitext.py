from senseloom.sources import dumps, wikitext


PAGE = """Lead of the page with ''some'' [[Target page|title]]s and a [[Other#Some part]] here.
{{Infobox|a={{nested|x}}|b=1}}
== First == 
A paragraph about {{convert|5|km}} and [http://x.org a label] that is long enough.<ref>gone</ref>

{| class="x"
| table || gone
|}
=== Below ===
* item one of the list is long enough to stay here
short
== First ==
Text of the second with [[File:x.png|thumb]] nothing &amp; everything [[fr:Autre|other]] inside it.

<nowiki>{{kept}}</nowiki>
"""


def test_parse():
    found, skipped = wikitext.parse(PAGE)
    assert [(s["index"], s["parent_index"], s["title"], s["ids"]) for s in found] == [(0, None, None, []), (1, None, "First", ["First"]), (2, 1, "Below", ["Below"]), (3, None, "First", ["First_2"])]
    text, links = found[0]["paragraphs"][0]
    assert text == "Lead of the page with some titles and a Other#Some part here."
    assert [(text[x.start : x.end], x.article, x.section) for x in links] == [("titles", "Target_page", None), ("Other#Some part", "Other", "Some_part")]
    assert "MEASUREMENT and a label" in found[1]["paragraphs"][0][0] and "gone" not in str(found)
    assert found[2]["paragraphs"][0][0].startswith("item one") and skipped == 2
    assert "nothing & everything other inside" in found[3]["paragraphs"][0][0]


def test_templates():
    p = wikitext.preprocess
    assert p("a {{Flag|France}} b {{unknown}} c") == "a France b   c"
    assert p("{{Quote|text=said}}") == "<blockquote>said</blockquote>"
    assert p("{{nihongo|Go|碁|igo}}") == "Go (碁?, igo)"
    assert p("{{vanchor|One|Two}}") == '<span id="Two"></span>One'
    assert p("a {{S-start}} x {{s-end}} b").split() == ["a", "b"]
    assert p("{{mine|1}}", {"Mine": lambda t: t.get("1") * 2}) == "11"
    assert p("x {{{a|{{b}}}}} y {{Flag|Z}}").endswith("Z")
    assert p("open {{never closed") == "open  "
    assert p("{{!}}{{=}}") == "&#124;&#61;"


def test_pages_to_tables(spark, tmp_path):
    xml = f"""<mediawiki><page><title>main page</title><ns>0</ns><id>1</id><revision><id>5</id><text xml:space="preserve" bytes="9">{PAGE.replace("&", "&amp;").replace("<", "&lt;")}</text><model>wikitext</model><format>text/x-wiki</format></revision></page>
<page><title>moved</title><ns>0</ns><id>2</id><redirect title="Main page"/><revision><id>6</id><text>#redirect [[main page#First &amp;amp; last]]</text><model>wikitext</model><format>text/x-wiki</format></revision></page>
<page><title>Talk:x</title><ns>1</ns><id>3</id><revision><id>7</id><text>no</text><model>wikitext</model><format>text/x-wiki</format></revision></page></mediawiki>"""
    (tmp_path / "d.xml").write_text(xml)
    a = {r.id: r for r in dumps.articles(dumps.read_pages(spark, str(tmp_path / "d.xml"))).collect()}
    assert set(a) == {1, 2} and a[1].title == "Main_page" and a[1].redirect_article_title is None
    assert (a[2].redirect_article_title, a[2].redirect_section_id) == ("Main_page", "First_.26_last")
    tables = wikitext.shred(wikitext.parse_pages(spark.createDataFrame([(1, PAGE), (2, None)], "id long, text string")))
    assert tables["sections"].count() == 4 and tables["section_ids"].count() == 3
    assert {r.linked_article for r in tables["links"].collect()} == {"Target_page", "Other"}


def test_sql_dumps(spark):
    lines = spark.createDataFrame([("INSERT INTO `page` VALUES (1,14,'It\\'s',0),(2,0,'No',0);",), ("INSERT INTO `other` VALUES (1,14,'x',0);",)], "value string")
    assert [tuple(r) for r in dumps.page_table(lines).collect()] == [(1, "It's")]
    links = spark.createDataFrame([("INSERT INTO `categorylinks` VALUES (7,'Top','K','2001','','uca','page'),(8,'It\\'s','','','','','subcat');",)], "value string")
    assert [tuple(r) for r in dumps.category_links(links).collect()] == [(7, "Top", "page"), (8, "It's", "subcat")]


def test_descriptor(tmp_path):
    name, d = dumps.Descriptor.of("x,2,c,pos")
    assert name == "x" and d == dumps.Descriptor(2, True, False, True, False, False)
    d.save(tmp_path / "d.json")
    assert dumps.Descriptor.load(tmp_path / "d.json") == d
    (tmp_path / "j.json").write_text('[{"dataset_name": "a", "model_name": "b", "target": {"metric_key": "accuracy"}, "test_sets": ["dev"]}]')
    assert dumps.load_jobs(tmp_path / "j.json")[0].test_sets == ("dev",)
