"""Scalar functions on titles, paragraphs and tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = tuple("!?()[]{}.,;:'\"")
RESIDUE = r"\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\|-|^\||align=|class=|style=|cellpadding=|cellspacing=|border=|<div|<span|<table|</"
LOSSLESS = r"(?s)\s+|[\p{L}\p{N}]+|."
NOUNS = ("NN", "NNS", "NNP", "NNPS", "FW")
WIKI = "https://en.wikipedia.org/wiki/"


def page_title(t: Column) -> Column:
    """Stripped, blanks as underscores, the first letter raised unless it is a sharp s."""
    s = F.translate(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), " ", "_")
    first = F.substring(s, 1, 1)
    return F.when(first == "ß", s).otherwise(F.concat(F.upper(first), F.substring(s, 2, 2147483646)))


def section_anchor(t: Column) -> Column:
    """Percent-encoded with a dot for the percent sign; colons stay."""
    out = F.url_encode(F.translate(t, " ", "_"))
    for a, b in (("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%", ".")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def group_title(t: Column) -> Column:
    """Lower-cased words of a title without one bracketed suffix and one leading article."""
    s = F.lower(F.translate(t, "_", " "))
    s = F.regexp_replace(s, r"^(.*) \(.*?\)$", "$1")
    return F.regexp_replace(s, r"^(?:a|an|the) (.*)$", "$1")


def sense_url(article: Column, section: Column) -> Column:
    return F.concat(F.lit(WIKI), article, F.when(section.isNotNull(), F.concat(F.lit("#"), section_anchor(section))).otherwise(""))


def has_residue(t: Column) -> Column:
    return t.rlike(RESIDUE)


def is_poor(t: Column) -> Column:
    """Fewer than 5 blank-separated items, under 15 characters, or under half ASCII letters."""
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (F.size(F.split(t, " ")) < 5) | (F.length(t) < 15) | (letters < 0.5 * F.length(t))


def collapse_space(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)\s{2,}|\n", " ")


def strip_style(t: Column) -> Column:
    return F.regexp_replace(t, "'{2,3}", " ")


def simplify_lists(t: Column) -> Column:
    marks = F.regexp_replace(t, r"(?m)^[ \t]*[#*;:]+[ \t]*", "\n\n")
    return F.regexp_replace(marks, r"(?i)</?(?:ol|ul|li)\b[^>]*>", "\n\n")


def unescape_sql(t: Column) -> Column:
    return F.replace(t, F.lit("\\'"), F.lit("'"))


def tsv_safe(t: Column) -> Column:
    return F.translate(F.coalesce(t.cast("string"), F.lit("")), "\n\t", "  ")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once, however often and in whatever lambda then has it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def n_grams(tokens: Column, n: int, least: int = 1) -> Column:
    """All runs of least..n tokens joined by underscores, shorter ones first; n = 1 gives the tokens."""
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        def runs(k: Column) -> Column:
            starts = F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - k + 1))
            return F.transform(starts, lambda _, j: F.array_join(F.slice(t, j + 1, k), "_"))

        return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(n)), runs))

    return bound(tokens, grams)


def join_tokens(tokens: Column, lemma: bool = False, strict: bool = False) -> Column:
    """Text of array<struct<value, lemma, before>>; a missing gap is one blank. strict: the first token keeps its value even with lemma."""

    def form(t: Column) -> Column:
        return F.coalesce(t["lemma"], t["value"]) if lemma else t["value"]

    def add(t: Column, i: Column) -> Column:
        first = t["value"] if strict else form(t)
        return F.when(i == 0, first).otherwise(F.concat(F.coalesce(t["before"], F.lit(" ")), form(t)))

    return F.array_join(F.transform(tokens, add), "")


def prepare_tokens(tokens: Column, n: int = 1, caseless: bool = True, skip_punctuation: bool = True, pos: bool = False, lemma: bool = False) -> Column:
    """Features of array<struct<value, pos, lemma>>: filter, form, case, part of speech, n-grams. Each token keeps its own part of speech."""
    kept = F.filter(tokens, lambda t: ~t["value"].isin(*PUNCTUATION)) if skip_punctuation else tokens

    def form(t: Column) -> Column:
        f = F.coalesce(t["lemma"], t["value"]) if lemma else t["value"]
        f = F.lower(f) if caseless else f
        return F.concat(f, F.lit("_"), F.coalesce(t["pos"], F.lit(""))) if pos else f

    return n_grams(F.transform(kept, form), n)


def bucket(token: Column, buckets: int) -> Column:
    """Feature hash that other engines can repeat: the first 60 bits of MD5."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint") % buckets


def quota(n: Column, share: float) -> Column:
    return F.bround(n * F.lit(share), 0).cast("bigint")


def noun_like(pos: Column) -> Column:
    """A span may be a phrase if its first tag is missing or any is a noun or foreign word."""
    return F.coalesce(F.get(pos, F.lit(0)).isNull() | F.exists(pos, lambda p: F.coalesce(p.isin(*NOUNS), F.lit(False))), F.lit(True))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
