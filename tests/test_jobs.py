import json

import pytest
from pyspark.sql import functions as F

from senseloom.operators import annotate, examples, infer, jobs, keep, sections, tokens, train
from senseloom.sources.dumps import Descriptor, Job

PLACE = "article_id long, section_index long, paragraph_index long, sentence_index long, label long"


def separable(spark, n=200):
    rows = [([f"w{k % 3}", f"x{k % 7}"], [0, 1, 2], k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "tokens array<string>, possible_senses array<long>, sense long").repartition(2)


def test_saved_model(spark, tmp_path):
    e = separable(spark)
    for hidden in ((), (6,)):
        model, _ = train.train(e, train.Params(buckets=1 << 10, rate=1.0, hidden=hidden), 3, 16, f"{tmp_path}/s{len(hidden)}")
        path = f"{tmp_path}/m{len(hidden)}"
        jobs.export(model, spark, path, Descriptor(2, uses_lemma=True), spark.range(3))
        again, descriptor = jobs.load_export(spark, path)
        assert descriptor == Descriptor(2, uses_lemma=True) and again.params == model.params and again.step == model.step
        same = lambda m: sorted(map(tuple, train.predict(e, m).collect()))
        assert same(again) == same(model)
        assert sorted(p.name for p in (tmp_path / f"s{len(hidden)}").iterdir()) == ["epoch=1", "epoch=2"]
    vectors, out = train.load_tables(spark, f"{tmp_path}/m0")
    model = train.load(spark, f"{tmp_path}/m0")
    one = spark.createDataFrame([(["w1", "x3", "w1"], [0, 2], 0)], e.schema)
    f = train.features(one, model.params).selectExpr("1 id", "explode(buckets) bucket")
    wanted = spark.createDataFrame([(1, 0), (1, 2)], "id int, label long")
    got = {r.label: r.logit for r in infer.logits(infer.pool(f, vectors, ["id"], 10), wanted, out, ["id"]).collect()}
    row = train.features(one, model.params).first()
    want = model.logits([int(b) for b in row.buckets], [0, 2])
    assert abs(got[0] - want[0]) < 1e-9 and abs(got[2] - want[1]) < 1e-9


def test_jobs(spark, tmp_path):
    for name in ("train", "dev", "test"):
        separable(spark).write.parquet(f"{tmp_path}/data/words/{name}")
    listed = [
        Job("words", "fixed", {"buckets": 1024, "rate": 1.0, "hidden": [4]}, 16, 6, None, ("train",), ("dev", "test")),
        Job("words", "until", {"buckets": 1024, "rate": 1.0}, 16, None, {"slope": 0.01, "over": 2, "most": 8}, ("train", "dev"), ("test",)),
    ]
    infos = jobs.run_jobs(spark, listed, f"{tmp_path}/data", f"{tmp_path}/out")
    assert len(infos[0]["values"]) == 6 and infos[0]["results"]["dev"]["n"] == 200 and set(infos[1]["results"]) == {"test"}
    assert infos[0]["results"]["test"]["accuracy"] > 0.9 and infos[1]["results"]["test"]["n_classes"] == 3
    assert json.loads(jobs.read_text(spark, f"{tmp_path}/out/fixed/info")) == json.loads(json.dumps(infos[0]))
    assert jobs.run_jobs(spark, listed, "/nowhere", f"{tmp_path}/out") == json.loads(json.dumps(infos))  # done already


def test_console(spark):
    df = jobs.console(spark, ["New York\n", "is big\n"])
    assert df.first().text == "New York\n\nis big\n"
    found = spark.createDataFrame([(4, 8, "b"), (0, 8, "a"), (9, 11, "c")], "start long, end long, url string").withColumn("k", F.lit(1))
    assert jobs.console_tree(infer.nested(found, ["k"])) == ["0-8 a", "  4-8 b", "9-11 c"]


def test_annotators(spark):
    df = spark.createDataFrame([(1, "Cats run. Dogs  ran"), (2, None), (3, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("cats", "NNS", "cat"), ("run", "VB", None)], "form string, pos string, lemma string")
    got = [(r.value, r.sentence, r.pos, r.lemma) for r in annotate.annotate(df, ["doc_id"], lexicon).orderBy("tok").collect()]
    assert got == [("Cats", 0, "NNS", "cat"), ("run", 0, "VB", None), (".", 0, None, None), ("Dogs", 1, None, None), ("ran", 1, None, None)]
    assert {r.pos for r in annotate.annotate(df, ["doc_id"]).collect()} == {None}

    def make():
        def words(text):
            out, at = [], 0
            for w in text.split():
                lo = text.index(w, at)
                at = lo + len(w)
                out.append((lo, at, "NN" if w[0].isupper() else None, w.lower()))
            return [out]

        return words

    rows = annotate.annotate(df, ["doc_id"], make=make).orderBy("tok").collect()
    assert [(r.value, r.pos, r.lemma, r.before, r.after, r.tok) for r in rows][2:] == [("Dogs", "NN", "dogs", " ", "  ", 3), ("ran", None, "ran", "  ", "", 4)]
    gate = infer.match(infer.spans(annotate.annotate(df, ["doc_id"], lexicon), ["doc_id"], 2), spark.createDataFrame([("run",), ("cats",), ("cats run",), ("ran",)], "phrase string"))
    assert sorted(r.phrase for r in gate.collect()) == ["cats", "cats run", "ran"]
    with pytest.raises(Exception, match="overlap"):
        annotate.annotate(df, ["doc_id"], make=lambda: lambda text: [[(0, 3, None, None), (2, 4, None, None)]]).collect()


def test_deep_sections(spark):
    n = 53
    rows = [(1, k, k - 1 if k else None, 1) for k in range(n)]
    s = spark.createDataFrame(rows, "article_id long, section_index long, parent_index long, paragraph_count long")
    total = {r.section_index: r.total_paragraph_count for r in sections.rollup(s).collect()}
    assert total == {k: n - k for k in range(n)}
    sgs = spark.createDataFrame([(5, 9)], "id long, sense long")
    senses = spark.createDataFrame([(9, 1, 3)], "id long, article_id long, section_index long")
    assert examples.paragraph_examples(sgs, senses, s).count() == n - 3
    loop = s.where("section_index < 3").withColumn("parent_index", (F.col("section_index") + 1) % 3)
    with pytest.raises(ValueError, match="cycle"):
        sections.rollup(loop)
    with pytest.raises(ValueError, match="cycle"):
        examples.paragraph_examples(sgs, senses.withColumn("section_index", F.lit(1)), loop)


def test_examples_together(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, 0, 2, 7), (1, 0, 0, 2, 7), (1, 0, 0, 3, 7)], PLACE)
    b = spark.createDataFrame([(1, 0, 0, None, 7), (1, 0, 0, None, 7)], PLACE)
    both = examples.all_examples(a, b)
    assert both.count() == 4
    sgs = spark.createDataFrame([(7, 1, 3), (8, 1, 4)], "id long, sense_group long, sense long")
    assert {tuple(r.possible_senses) for r in examples.export_rows(both, sgs).collect()} == {(7, 8)}
    assert examples.check_least(both, 4).first().n == 4
    with pytest.raises(ValueError, match="label 7"):
        examples.check_least(both, 5)
    examples.write_additional(f"{tmp_path}/x", groups=sgs)
    examples.write_additional(f"{tmp_path}/x", groups=sgs.limit(0))
    assert spark.read.parquet(f"{tmp_path}/x/groups").count() == 2


def test_long_text_is_linear(spark):
    """Offsets of some hundred thousand tokens, within one row."""
    text = "é word, and " * 40_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    last = tokens.tokens(df, ["doc_id"]).orderBy(F.desc("tok")).first()
    assert (last.tok, last.start, last.value) == (160_000, len(text) - 4, "and")
    kept = keep.keep(df)
    keep.drop(kept)
    with pytest.raises(Exception):
        kept.count()
