"""Steps that must not grow faster than their input, nor gather it anywhere."""

import pytest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["link_resolve", "sense_urls"])
def test_tables_of_pages_are_not_broadcast(spark, sf, query):
    from senseloom.plans import registry

    assert "Broadcast" not in plan(registry.queries()[query](spark, sf))


ODD = ["  Hello, World!  It's 3.5.\nNew\n\nline 🙂 é x", "", None, " \t\n", "one", "a.b. ²½ 漢字カナ é _x_ y", "\x0b\x0c\rend. ", "z" * 3000 + " 9"]


def test_tokens_are_those_of_the_pattern(spark):
    from pyspark.sql import functions as F

    from senseloom.functions.text import LOSSLESS
    from senseloom.operators import tokens

    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    pieces = {r.doc_id: r.p for r in df.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LOSSLESS), F.lit(0)).alias("p")).collect()}
    got = tokens.tokens(df, ["doc_id"], sentence=True).collect()
    want, gap = [], lambda p: p.strip("\t\n\x0b\x0c\r ") == ""
    for d, ps in pieces.items():
        at, tok, sentence = 0, 0, 0
        for i, p in enumerate(ps):
            if not gap(p):
                tok += 1
                near = [ps[j] if 0 <= j < len(ps) and gap(ps[j]) else "" for j in (i - 1, i + 1)]
                want.append((d, tok, at, at + len(p), p, *near, sentence))
                sentence += p in ".!?" and near[1] != ""
            at += len(p)
    assert sorted(map(tuple, got)) == sorted(want)
    old = tokens.sentences(tokens.tokens(df, ["doc_id"]), ["doc_id"]).select("doc_id", "tok", "sentence")
    assert sorted(map(tuple, old.collect())) == sorted((w[0], w[1], w[-1]) for w in want)
    s = {(r.doc_id, r.sentence): (r.start, r.end, r.tokens) for r in tokens.sentence_rows(df, ["doc_id"]).collect()}
    assert sum(len(x[2]) for x in s.values()) == len(want) and s[0, 0] == (2, 15, ["Hello", ",", "World", "!"])
    n = {r.doc_id: r.n for r in df.select("doc_id", tokens.count_tokens(F.col("text")).alias("n")).collect() if r.n}
    assert n == {d: sum(w[0] == d for w in want) for d in {w[0] for w in want}}


def test_spans_with_tags_are_those_of_tagged_tokens(spark):
    from senseloom.operators import annotate, infer

    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    lexicon = spark.createDataFrame([("hello", "NN", "a"), (",", "VB", "b"), ("world", "DT", None)], "form string, pos string, lemma string")
    want = infer.spans(annotate.annotate(df, ["doc_id"], lexicon), ["doc_id"], 3)
    got = infer.text_spans(df, ["doc_id"], 3, lexicon=lexicon)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("query", ["tokenize_lossless", "annotated_tokens", "min_tokens", "reconstruct_text", "prepare_tokens", "token_join", "sentence_split"])
def test_tokens_are_not_shuffled(spark, sf, query):
    from senseloom.plans import registry

    assert "hashpartitioning(doc_id" not in plan(registry.queries()[query](spark, sf)).replace("#", " ").replace("  ", " ").replace("doc_id ", "doc_id")


def test_greedy_division_streams(spark):
    """One component of many places equals the division by plain loops, also where Arrow batches end within a label."""
    from senseloom.operators import examples

    rows = [(a, 0, p, None, (a * 7 + p * p) % 11) for a in range(300) for p in range(4)]
    e = spark.createDataFrame([*rows, *((a, 0, 0, None, 20) for a in range(300))], "article_id long, section_index long, paragraph_index long, sentence_index long, label long").distinct()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = examples.split_greedy(e, examples.label_components(e))
        got = {(r.article_id, r.paragraph_index, r.label): r.dataset for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan(df)
    by: dict[int, list] = {}
    for r in e.withColumn("k", examples._key_hash()).collect():
        by.setdefault(r.label, []).append((r.k, r.article_id, r.paragraph_index))
    placed, want = {}, {}
    for label in sorted(by, reverse=True):
        q, have = round(len(by[label]) * 0.15), [0, 0, 0]
        for k, a, p in sorted(by[label]):
            if k not in placed:
                placed[k] = next((d for d in (1, 2) if have[d] < q), 0)
            have[placed[k]] += 1
            want[a, p, label] = placed[k]
    assert got == want


def test_lists_of_a_group_meet_examples_last(spark):
    from senseloom.operators import examples

    e = spark.createDataFrame([(1, 0, 0, 2, 7, 1), (1, 0, 0, 3, 8, 0)], "article_id long, section_index long, paragraph_index long, sentence_index long, label long, dataset int")
    sgs = spark.createDataFrame([(7, 1, 3), (8, 1, 4), (9, 2, 4)], "id long, sense_group long, sense long")
    assert {tuple(r) for r in examples.export_rows(e, sgs, True).collect()} == {(7, 1, 0, 0, 2, 1, 1, "7,8"), (8, 1, 0, 0, 3, 0, 1, "7,8")}


def test_vectors_go_to_chunks_of_rows(spark, monkeypatch):
    from senseloom.operators import infer

    monkeypatch.setattr(infer, "POOLED", 3)
    f = spark.createDataFrame([(d, (d * k) % 5) for d in range(10) for k in range(1, 200)], "id long, bucket long")
    v = spark.createDataFrame([(b, [float(b), 1.0]) for b in range(4)], "bucket long, vec array<double>")
    df = infer.pool(f, v, ["id"], 2)
    for r in df.collect():
        known = [b for k in range(1, 200) if (b := (r.id * k) % 5) < 4]
        assert abs(r.x[0] - sum(known) / len(known)) < 1e-9 and abs(r.x[1] - 1) < 1e-9
    assert df.count() == 10 and "Join" not in plan(df)


def test_pooled_words_are_not_shuffled(spark, monkeypatch):
    """Rows of buckets sum up as plain loops do: repeated keys and buckets, unknown and null ones, vectors in several blocks."""
    from senseloom.operators import infer

    monkeypatch.setattr(infer, "POOLED", 2)
    lists = {0: [1, 1, 2, 99, None], 1: [], 2: None, 3: [50], 4: [3] * 9 + [7], None: [2, 3]}
    rows = [*lists.items(), (0, [7]), (None, [1])]
    f = spark.createDataFrame(rows, "id long, buckets array<long>").repartition(3)
    vecs = [(b, [float(b), b * b / 3]) for b in (1, 2, 3, 7)] + [(7, [1.0, 1.0]), (5, None)]
    v = spark.createDataFrame(vecs, "bucket long, vec array<double>")
    df = infer.pool(f, v, ["id"], 2, "sqrtn")
    want = {}
    for k, bs in rows:
        want.setdefault(k, []).extend(x for b in bs or [] for c, x in vecs if b == c and x)
    got = {r.id: r.x for r in df.collect()}
    assert got.keys() == {k for k, x in want.items() if x}
    for k, x in got.items():
        assert all(abs(y - sum(c) / len(want[k]) ** 0.5) < 1e-9 for y, c in zip(x, zip(*want[k])))
    assert "Join" not in plan(df) and "Generate" not in plan(df)


@pytest.mark.parametrize("step", [0.0, 0.3])
def test_losses_over_a_batch_make_no_pairs(spark, monkeypatch, step):
    from math import exp, log

    from pyspark.sql import functions as F

    from senseloom.operators import infer

    monkeypatch.setattr(infer, "POOLED", 50)
    monkeypatch.setattr(infer, "keep", kept := Kept())
    ids, labels = range(400), range(1000)
    x = {i: [((i * 7) % 11 - 5) / 5, ((i * 3) % 13 - 6) / 6] for i in ids}
    w = {k: ([((k * 5) % 17 - 8) / 8, ((k * 9) % 7 - 3) / 3], k * step) for k in labels}
    pooled = spark.createDataFrame(list(x.items()), "id long, x array<double>")
    out = spark.createDataFrame([(k, *v) for k, v in w.items()], "label long, w array<double>, b double")
    sense = lambda i: i * 3 % 1000 if i != 7 else 9999
    examples = spark.createDataFrame([(i, i % 2 if i != 8 else None, sense(i)) for i in ids], "id long, batch int, sense long")
    wanted = {i: {i * 3 % 1000, (i * 7 + 1) % 1000} for i in ids}
    df = infer.batch_losses(pooled, examples, spark.createDataFrame([(i, k) for i, ks in wanted.items() for k in ks], "id long, label long"), out, ["id"])
    got = {r.id: r.loss for r in df.collect()}
    union = {b: set().union(*(ks for i, ks in wanted.items() if i % 2 == b and i != 8)) for b in (0, 1)}
    dot = lambda i, k: sum(p * q for p, q in zip(x[i], w[k][0])) + w[k][1]
    assert got.keys() == set(ids) - {8} and got[7] is None
    for i in set(ids) - {7, 8}:
        z = [dot(i, k) for k in union[i % 2]]
        assert abs(max(z) + log(sum(exp(y - max(z)) for y in z)) - dot(i, sense(i)) - got[i]) < 1e-9
    rows, of, sizes = kept.tables[:3]
    near = infer.near_labels(of, sizes).groupBy("batch").agg(F.count("*").alias("k")).collect()
    assert all(r.k == len(union[r.batch]) if step == 0 else r.k < len(union[r.batch]) / 2 for r in near)
    assert of.count() == sum(map(len, union.values())) and rows.count() == len(ids) - 1


class Kept:
    def __init__(self):
        self.tables = []

    def __call__(self, df):
        from senseloom.operators.keep import keep

        self.tables.append(keep(df))
        return self.tables[-1]
