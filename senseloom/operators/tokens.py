"""Tokens, sentences and paragraphs of plain text, within the rows of the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.arrays import let, running
from . import cutting
from .keep import ship


def paragraphs(docs: DataFrame, separator: str = r"\n") -> DataFrame:
    """(doc_id, par_idx, start, text): pieces between separators with their place; empty ones are left out but for the numbers.

    Places are made within the row, so nothing is shuffled.
    """
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s)(?:{separator})|(?:(?!{separator}).)+"), F.lit(0))
    at = docs.select("doc_id", pieces.alias("ps")).withColumn("gaps", F.transform("ps", lambda p: p.rlike(f"^(?:{separator})$").cast("int")))
    row = f"transform(ps, (p, i) -> struct(cast(z.n[i] as bigint) as par_idx, cast(z.e[i] - length(p) as bigint) as start, p as text, gaps[i] as gap))"
    placed = F.expr(let("z", f"struct({running('transform(ps, p -> length(p))')} as e, {running('gaps')} as n)", row))
    return at.select("doc_id", F.explode(placed).alias("x")).where("x.gap = 0").select("doc_id", "x.par_idx", "x.start", "x.text")


def _cut(docs: DataFrame, key: list[str], column: str, make: Callable, fields: str) -> DataFrame:
    """(key, fields) of what make() takes out of the texts, batch by batch; nothing is shuffled."""
    ship(docs.sparkSession)
    new = _parse_datatype_string(fields).fields
    types = list(to_arrow_schema(StructType(new)))
    return docs.select(*key, F.col(column).alias("__text")).mapInArrow(lambda batches: cutting.cuts(batches, make, types), StructType([*docs.select(*key).schema.fields, *new]))


_TOKEN = "start long, end long, value string, before string, after string"


def token_arrays(docs: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """(key, tokens array<struct<start, end, value, before, after>>) of every text: its tokens with the gaps around them."""
    return _cut(docs, key, column, cutting.arrays_of, f"tokens array<struct<{_TOKEN.replace(' ', ': ').replace(',:', ',')}>>")


def tokens(pieces_of: DataFrame, key: list[str], column: str = "text", sentence: bool = False) -> DataFrame:
    """One row for each token of a text: number, start, end, value, before and after (the gaps); they join to the text without loss.

    All within the row: a text's tokens are never shuffled. With sentence, also what sentences() adds.
    """
    return _cut(pieces_of, key, column, lambda cut: cutting.rows_of(cut, sentence), f"tok int, {_TOKEN}" + ", sentence long" * sentence)


def sentence_rows(docs: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """(key, sentence, start, end, tokens array<string>): the sentences of texts, made within the row."""
    return _cut(docs, key, column, cutting.sentences_of, "sentence long, start long, end long, tokens array<string>")


def span_rows(docs: DataFrame, key: list[str], longest: int, column: str = "text", forms: bool = False) -> DataFrame:
    """(key, start, end, run): runs of up to longest tokens as they stand in the text; with forms, also the values of their tokens."""
    return _cut(docs, key, column, lambda cut: cutting.spans_of(cut, longest, forms), "start long, end long, run string" + ", forms array<string>" * forms)


def word_runs(docs: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """(key, run): the words (runs of letters) of texts and the pairs of words that follow each other, joined by a blank; each once for a batch of texts."""
    ship(docs.sparkSession)
    types = list(to_arrow_schema(StructType(_parse_datatype_string("run string").fields)))
    schema = StructType([*docs.select(*key).schema.fields, *_parse_datatype_string("run string").fields])
    return docs.select(*key, F.col(column).alias("__text")).mapInArrow(lambda batches: cutting.word_runs(batches, types), schema)


def count_tokens(t: Column) -> Column:
    """The number of tokens of a text."""
    return F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def sentences(token_rows: DataFrame, key: list[str]) -> DataFrame:
    """Tokens with sentence: a new one begins after . ! or ? that white space follows."""
    w = Window.partitionBy(*key).orderBy("tok")
    stop = (F.col("value").isin(".", "!", "?") & (F.col("after") != "")).cast("int")
    return token_rows.withColumn("sentence", F.coalesce(F.sum(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def reconstructed(token_rows: DataFrame, key: list[str]) -> DataFrame:
    """The text that the tokens stand for, for the check that nothing was lost but outer white space before the first."""
    s = F.array_sort(F.collect_list(F.struct("tok", "value", "after")))
    return token_rows.groupBy(*key).agg(s.alias("t")).select(*key, F.expr("array_join(transform(t, x -> concat(x.value, x.after)), '')").alias("text"))


def rejoined(docs: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """The rows of reconstructed() for the tokens of texts, put together within the row."""
    t = token_arrays(docs, key, column).where("size(tokens) > 0")
    return t.select(*key, F.expr("array_join(transform(tokens, x -> concat(x.value, x.after)), '')").alias("text"))
