import pytest
from pyspark.sql import functions as F

from senseloom.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("x, y", [("  the quick fox ", "The_quick_fox"), ("ßeta x", "ßeta_x"), ("éa", "Éa"), ("", ""), (None, None), (" a ", "A")])
def test_page_title(spark, x, y):
    assert one(spark, x, text.page_title) == y


def test_anchor(spark):
    assert one(spark, "A b/c:d~e*(f)é+", text.section_anchor) == "A_b.2Fc:d~e.2A.28f.29.C3.A9.2B"


@pytest.mark.parametrize("x, y", [("Mercury_(planet)", "mercury"), ("The_Foo_(bar)_(baz)", "foo (bar)"), ("An Apple", "apple"), ("the", "the"), ("", ""), (None, None)])
def test_group_title(spark, x, y):
    assert one(spark, x, text.group_title) == y


@pytest.mark.parametrize("x, n, y", [(["a", "b", "c"], 2, ["a", "b", "c", "a_b", "b_c"]), (["a", "b"], 5, ["a", "b", "a_b"]), ([], 2, []), (["a"], 1, ["a"])])
def test_n_grams(spark, x, n, y):
    assert one(spark, x, lambda c: text.n_grams(c, n), "array<string>") == y


@pytest.mark.parametrize("x, y", [(10, 2), (14, 2), (30, 4), (50, 8), (70, 10)])
def test_quota(spark, x, y):
    assert one(spark, x, lambda c: text.quota(c, 0.15), "long") == y


@pytest.mark.parametrize("x, y", [([None, "VB"], True), (["VB", None], False), (["DT", "NN"], True), (["DT"], False), ([], True)])
def test_noun_like(spark, x, y):
    assert one(spark, x, text.noun_like, "array<string>") is y


def test_join_and_prepare(spark):
    t = [("The", "the", None, "DT"), ("cats", "cat", " ", "NNS"), (".", ".", "", ".")]
    kind = "array<struct<value: string, lemma: string, before: string, pos: string>>"
    assert one(spark, t, text.join_tokens, kind) == "The cats."
    assert one(spark, t, lambda c: text.join_tokens(c, True), kind) == "the cat."
    assert one(spark, t, lambda c: text.join_tokens(c, True, True), kind) == "The cat."
    assert one(spark, t, lambda c: text.prepare_tokens(c, 2, pos=True, lemma=True), kind) == ["the_DT", "cat_NNS", "the_DT_cat_NNS"]


def test_quality(spark):
    assert one(spark, "a b c d", text.is_poor) is True
    assert one(spark, "these words are quite fine", text.is_poor) is False
    assert one(spark, "1234 5678 9012 3456 words", text.is_poor) is True
    assert one(spark, "a {{b}} c", text.has_residue) is True


def test_whole_titles_equal_their_sql(spark, sf):
    import duckdb

    from senseloom.plans import registry

    db = duckdb.connect()
    for t in ("part", "supplier", "pages"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("normalize_whole_titles", "whole_section_anchor"):
        got = sorted(tuple(r) for r in registry.queries()[name](spark, sf).collect())
        assert got == sorted(db.execute(registry.oracle_sql()[name]).fetchall())
        assert max(len(r[2]) for r in got) > 40
