import pytest
from pyspark.sql import functions as F

from senseloom.operators import categories, examples, infer, links, sections, senses, tokens, train


def test_rollup(spark):
    s = spark.createDataFrame([(1, 0, None, 2), (1, 1, 0, 1), (1, 2, 1, 3)], "article_id long, section_index long, parent_index long, paragraph_count long")
    assert [r.total_paragraph_count for r in sections.rollup(s).orderBy("section_index").collect()] == [6, 4, 3]


def test_parents(spark):
    s = spark.createDataFrame([(1, k, x) for k, x in enumerate([None, 2, 3, 3, 2])] + [(2, 0, None), (2, 1, 3)], "article_id long, section_index long, level int")
    got = {(r.article_id, r.section_index): r.parent_index for r in sections.parents(s).collect()}
    assert [got[1, k] for k in range(5)] == [None, None, 1, 1, None] and got[2, 1] == 0


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "category_id long, subcategory_id long")
    root = spark.createDataFrame([(1,)], "category_id long")
    assert sorted(r.category_id for r in categories.closure(e, root).collect()) == [1, 2, 3]
    assert categories.closure(e, root.limit(0)).collect() == []


def test_redirects(spark):
    r = spark.createDataFrame([("A", "B", "s1"), ("D", "B", None), ("B", "C", "s2")], "title string, target string, section string")
    got = {x.title: (x.target, x.section) for x in links.resolve_redirects(r).collect()}
    assert got == {"A": ("C", "s1"), "D": ("C", "s2"), "B": ("C", "s2")}


def test_sentence_of(spark):
    df = spark.createDataFrame([(11, [12, 30]), (12, [12, 30])], "b int, e array<int>")
    assert [r.s for r in df.select(links.sentence_of(F.col("b"), F.col("e")).alias("s")).collect()] == [0, 1]


def test_best_and_nested(spark):
    s = spark.createDataFrame([(0, 5, 1.0), (0, 9, 1.0), (0, 7, 0.5)], "k long, label long, logit double")
    assert infer.best_sense(s, ["k"]).first().label == 9
    n = spark.createDataFrame([(0, 0, 10), (0, 0, 3), (0, 4, 10), (0, 9, 13), (0, 11, 12)], "k long, start long, end long")
    assert [r.nested for r in infer.nested(n, ["k"]).orderBy("start", F.desc("end")).collect()] == [0, 1, 1, 0, 1]


def test_tokens_lose_nothing(spark):
    texts = ["  Hello, World!  It's 3.5.\nNew\n\nline 🙂 é", "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = tokens.tokens(df, ["doc_id"])
    for r in t.collect():
        assert texts[r.doc_id][r.start : r.end] == r.value
    assert {r.doc_id: r.text for r in tokens.reconstructed(t, ["doc_id"]).collect()} == {0: texts[0].lstrip(), 2: "one"}
    p = {(r.doc_id, r.par_idx): (r.start, r.text) for r in tokens.paragraphs(df).collect()}
    assert p[0, 3] == (texts[0].index("line"), "line 🙂 é") and (0, 2) not in p


def test_spans_equal_a_search(spark):
    df = spark.createDataFrame([(1, "Hello, World! new york New York")], "doc_id long, text string")
    ph = spark.createDataFrame([("hello, world",), ("world",), ("new york",), ("york new",)], "phrase string")
    s = infer.match(infer.spans(tokens.tokens(df, ["doc_id"]), ["doc_id"], 3), ph)
    low = "hello, world! new york new york"
    want = sorted((i, i + len(p)) for p in ("hello, world", "world", "new york", "york new") for i in range(len(low)) if low.startswith(p, i))
    assert sorted((r.start, r.end) for r in s.collect()) == want


def test_dense_ids(spark):
    df = spark.createDataFrame([(k, k * 7919 % 101) for k in range(500)], "k long, m long")
    got = senses.dense_ids(df, [F.desc("m"), F.asc("k")], parts=5).collect()
    assert [(r.k, r.m) for r in sorted(got, key=lambda r: r.id)] == sorted(((r.k, r.m) for r in got), key=lambda x: (-x[1], x[0]))
    assert sorted(r.id for r in got) == list(range(500))


def _examples(spark):
    rows = [(a, 0, p, None, (a * 7 + p) % 5) for a in range(40) for p in range(5)] + [(a, 0, 0, None, 9) for a in range(40)]
    return spark.createDataFrame(rows, "article_id long, section_index long, paragraph_index long, sentence_index long, label long")


def test_owner_split(spark):
    e = _examples(spark)
    got = examples.split_by_owner(e).collect()
    sets = {}
    for r in got:
        assert sets.setdefault((r.article_id, r.paragraph_index), r.dataset) == r.dataset
    rare = [r.dataset for r in got if r.label == 9]
    assert (rare.count(1), rare.count(2)) == (6, 6) and len(got) == e.count()


def test_greedy_split(spark):
    e = _examples(spark)
    c = examples.label_components(e)
    assert {r.component for r in c.collect()} == {0}
    got = examples.split_greedy(e, c).collect()
    sets = {}
    for r in got:
        assert sets.setdefault((r.article_id, r.paragraph_index), r.dataset) == r.dataset
    for label in range(5):
        n = [r.dataset for r in got if r.label == label]
        assert n.count(1) >= round(len(n) * 0.15) and n.count(2) >= round(len(n) * 0.15)


def test_components_of_a_long_chain(spark):
    rows = [(a, 0, 0, None, a + k) for a in range(60) for k in (0, 1)]
    e = spark.createDataFrame(rows, "article_id long, section_index long, paragraph_index long, sentence_index long, label long")
    assert {(r.label, r.component) for r in examples.label_components(e, 8).collect()} == {(k, 0) for k in range(61)}
    with pytest.raises(RuntimeError):
        examples.label_components(e, 2)


def test_training_separates(spark):
    rows = [([f"w{k % 3}", f"x{k % 7}"], [0, 1, 2], k % 3) for k in range(300)]
    e = spark.createDataFrame(rows, "tokens array<string>, possible_senses array<long>, sense long").repartition(2)
    for hidden in ((), (8,)):
        model, losses = train.train(e, train.Params(buckets=1 << 12, rate=1.0, hidden=hidden), 12, 16)
        assert losses[-1] < losses[0]
        p = train.predict(e, model).collect()
        assert sum(r.sense == r.predicted for r in p) / len(p) > 0.95
