"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A document holds a window of an item if it holds all its words in a row, hence
all its shingles. For full containment one necessary token is enough as the
prefix: each window is looked up by the rarest of its shingles, by their counts over
all documents, so that a frequent shingle meets nothing. What it meets is held to the bounds
of place and length and then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle, at most.
SHINGLE = 3
#: Shingles (twelve bytes each) that are sent to every executor; more are joined by a shuffle.
MOST_SENT = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _key(words: str, at: str, width: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {at} + {k})' for k in range(width))})"


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window array<string>, items array<string>): each different window with the ids of the items that hold it."""
    w = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    cut = f"explode(transform(sequence(1, greatest(1, size(w) - {size} + 1)), i -> slice(w, i, {size})))"
    return w.where("size(w) > 0").selectExpr("item", f"{cut} window").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """docs(rid, doc_id, words) by word: pos and key for each width of shingle; a document without words has one row with neither."""
    at = docs.selectExpr("rid", "doc_id", "words", "size(words) n_words", "posexplode_outer(words) (pos, word)").drop("word")
    if len(widths) == 1:
        return at.selectExpr("*", f"{widths[0]} width", f"{_key('words', 'pos', widths[0])} key")
    keys = ", ".join(f"struct({k} width, {_key('words', 'pos', k)} key)" for k in widths)
    return at.selectExpr("*", f"explode(array({keys})) k").selectExpr("*", "k.width", "k.key").drop("k")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of documents(doc_id, text, ...) against benchmark(item_id, text, ...).

    n_hit: words inside any occurrence of an item's window of size consecutive words;
    an item of fewer words, but not none, is one window. items: the ids, as
    strings in order, of items with occurring windows.

    A null or empty text has no words and no hits; an item without words or without an id
    matches nothing. Repeated rows of documents give rows of their own, repeated items and
    windows count once. Other columns aren't looked at. With an empty benchmark nothing is
    hit. The words of a text are taken apart within its row, and only hits are
    gathered by row, so neither long texts nor groups of copies meet in one place.
    """
    tables = Tables(docs.sparkSession)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words"))
    windows = tables.write(item_windows(benchmark, size).withColumn("width", F.least(F.lit(SHINGLE), F.size("window"))).withColumn("length", F.size("window")))
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # SHINGLE of them at most
    if not widths:
        return base.selectExpr("doc_id", "cast(size(words) as long) n_words", "0L n_hit", "cast(array() as array<string>) items")

    by_width = " ".join(f"when {k} then {_key('window', 'i', k)}" for k in widths)
    shingles = windows.selectExpr("*", "explode(sequence(0, length - width)) i").selectExpr("*", f"case width {by_width} end key")
    known = tables.write(shingles.select("width", "key").distinct().withColumn("met", F.lit(True)))
    sent = known.limit(most_sent + 1).count() <= most_sent

    # the only pass over the words: what met a shingle, with the words of any window around it, and one row of each document
    around = f"slice(words, greatest(0, pos - {size}) + 1, {2 * size + SHINGLE})"
    rows = ("rid", "doc_id", "n_words", "pos", "width", "key", "met", "around")
    if sent:
        met = positions(base, widths).join(F.broadcast(known), ["width", "key"], "left").where("met or coalesce(pos, 0) = 0").withColumn("around", F.expr(f"if(met, {around}, null)")).select(*rows)
    else:
        at = positions(base, widths)
        one = at.where(f"coalesce(pos, 0) = 0 and width = {widths[0]}").selectExpr("rid", "doc_id", "n_words", "pos", "width", "key", "false met", "cast(null as array<string>) around")
        met = at.where("pos is not null").withColumn("around", F.expr(around)).join(known, ["width", "key"]).select(*rows).unionByName(one)
    seen = tables.write(met)
    counts = seen.where("met").groupBy("width", "key").agg(F.count("*").alias("n"))
    rarest = shingles.join(counts, ["width", "key"], "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "i", "width", "length", "items")).alias("r"))
    # a window with a shingle that no document holds occurs in none
    prefixes = tables.write(rarest.where("r.n > 0").selectExpr("r.key pkey", "r.width pwidth", "r.i i", "r.length length", "window", "r.items items"))

    fits = f"met and key = pkey and width = pwidth and pos >= i and pos - i + length <= n_words and slice(around, least(pos, {size}) - i + 1, length) = window"
    found = seen.join(prefixes, F.expr(fits)).selectExpr("rid", "doc_id", "n_words", "pos - i start", "length", "items")
    every = seen.where("coalesce(pos, 0) = 0").selectExpr("rid", "doc_id", "n_words", "cast(null as int) start", "cast(null as int) length", "cast(null as array<string>) items")
    hits = found.unionByName(every)

    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))))
    by_row = hits.groupBy("rid", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("s"), F.collect_set("items").alias("i"))
    union = "aggregate(s, struct(0 as e, 0L as t), (a, x) -> struct(greatest(a.e, x.start + x.length) as e, a.t + greatest(0, x.start + x.length - greatest(a.e, x.start)) as t), a -> a.t)"
    return by_row.selectExpr("doc_id", "n_words", f"{union} n_hit", "array_sort(array_distinct(flatten(i))) items")


def digest(found: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated in place of the list of items."""
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) n_items", "sha2(array_join(items, ','), 256) items_sha256", "n_hit > 0 contaminated")


_LETTERS = f"'{UPPER}', '{LOWER}'"
ORACLE = rf"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{WORD}') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{WORD}') w from benchmark where item_id is not null),
win as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
        from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
lens as (select distinct n from win),
g as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') g
      from (select rid, n, w, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n)),
hit as (select rid, item_id, i, win.n from g join win on g.g = win.g and g.n = win.n),
places as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
it as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) items from hit group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join places using (rid) left join it using (rid)
"""
