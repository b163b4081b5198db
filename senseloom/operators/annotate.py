"""Tags and lemmas of tokens: by a lexicon within Spark, or by an annotator of the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: What an annotator makes of a text: sentences of tokens (start, end, tag or None, lemma or None), by code points and in order.
Annotated = list[list[tuple[int, int, str | None, str | None]]]


def by_lexicon(token_rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Token rows with pos and lemma from lexicon(form, pos, lemma), a form being a lower-cased value that stands in it once; null where it isn't there."""
    named = lexicon.select(F.col("form").alias("__form"), "pos", "lemma")
    return token_rows.join(named, F.lower("value") == F.col("__form"), "left").drop("__form")


def by_annotator(docs: DataFrame, key: list[str], make: Callable[[], Callable[[str], Annotated]], column: str = "text") -> DataFrame:
    """Token rows (key, sentence, tok, start, end, value, before, after, pos, lemma) of an annotator, which make() makes once in each task.

    before and after are the white space next to a token. Null texts have no tokens; tokens that overlap or lie outside of the text are an error.
    """
    schema = docs.select(*key).schema
    types = "sentence int, tok int, start long, end long, value string, before string, after string, pos string, lemma string"
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = StructType([*schema.fields, *_parse_datatype_string(types).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        annotate, fields = make(), to_arrow_schema(out)
        for b in batches:
            for row in b.to_pylist():
                text, found = row.pop("__text") or "", []
                spans = [(k, *t) for k, sentence in enumerate(annotate(text) if text else []) for t in sentence]
                for i, (k, lo, hi, pos, lemma) in enumerate(spans):
                    before, after = spans[i - 1][2] if i else 0, spans[i + 1][1] if i + 1 < len(spans) else len(text)
                    if not before <= lo <= hi <= after <= len(text):
                        raise ValueError("tokens overlap or lie outside of the text")
                    gaps = [g if g.isspace() else "" for g in (text[before:lo], text[hi:after])]
                    found.append(row | {"sentence": k, "tok": i + 1, "start": lo, "end": hi, "value": text[lo:hi], "before": gaps[0], "after": gaps[1], "pos": pos, "lemma": lemma})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=fields)

    return docs.select(*key, F.col(column).alias("__text")).mapInArrow(run, out)


def annotate(docs: DataFrame, key: list[str], lexicon: DataFrame | None = None, make: Callable[[], Callable[[str], Annotated]] | None = None, column: str = "text") -> DataFrame:
    """Token rows with sentence, pos and lemma: of an annotator if one is given, else of the tokens of Spark's own with what the lexicon knows."""
    if make is not None:
        return by_annotator(docs, key, make, column)
    rows = tokens.tokens(docs, key, column, sentence=True)
    none = F.lit(None).cast("string")
    return by_lexicon(rows, lexicon) if lexicon is not None else rows.withColumn("pos", none).withColumn("lemma", none)
