"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common neighbour half way.
With r = 3 a ball of half the radius (one bit) on either side meets pairs of up to two
differing bits, and one of two bits (2,081 variants of each fingerprint) would be needed for the
third. Instead the 64 bits are cut into four bands: of three differing bits at
least one lies in some band, and with this band left out at most two
are left, for which one-bit balls on both sides meet. So each distinct
fingerprint emits, for each band left out, its 48 other bits and their 48
one-bit variants: 196 keys. Fingerprints that share a key are compared bit by
bit.

A key that many distinct fingerprints share (variants of one hot text) isn't
paired off. Its fingerprints emit their full balls of one and of two bits instead;
whoever holds a variant in the small ball is within three bits of all that
hold it in the large one, so each is linked to the smallest of these, without
comparing pairs. A variant has at most 2,081 distinct holders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Tables, connected_components, slices

BANDS, BAND = 4, 16
RADIUS = 3
#: A key with more distinct fingerprints is left to the full balls.
PAIRED = 32


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half of the XXH64 of the shingles have it set."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        hi = min(lo + 65536, n)
        some = words[lo : hi + width - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = np.concatenate([[0], ends[:-1]])
        last = ends[min(width, len(some)) - 1 :] - 1
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print) for each row; print holds the 64 bits as a long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = [fingerprint(x, width, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()), "print": pa.array(np.array(prints, "<u8").view("<i8"), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, tables: Tables) -> DataFrame:
    """(a, b) between distinct fingerprints of column print: all pairs within the radius that share no hot key, and for the others links that connect what is within the radius.

    No link joins two fingerprints that aren't connected by steps within the radius.
    """
    keys = []
    for band in range(BANDS):
        mask = ((1 << 64) - 1) ^ (((1 << BAND) - 1) << (BAND * band))
        # the band left out holds its own number; keys of two bands may still agree, and the comparison decides
        base = F.col("print").bitwiseAND(F.lit(_long(mask))).bitwiseOR(F.lit(_long(band << (BAND * band))))
        flips = [0, *(1 << k for k in range(64) if k // BAND != band)]
        keys += [base.bitwiseXOR(F.lit(_long(f))) for f in flips]
    emitted = prints.select("print", F.explode(F.array(*keys)).alias("at"))
    met = emitted.withColumn("n", F.count("*").over(Window.partitionBy("at"))).where("n > 1")
    members = tables.write(met)
    few = members.where(F.col("n") <= PAIRED).select("at", "print")
    pairs = few.alias("x").join(few.alias("y").hint("merge"), "at").where("x.print < y.print").selectExpr("x.print a", "y.print b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    close = pairs.where(near)

    hot = members.where(F.col("n") > PAIRED).select("print").distinct()
    flips1 = [0, *(1 << k for k in range(64))]
    one = F.array(*(F.lit(_long(x)) for x in flips1))
    pairs_of_bits = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    small = hot.select("print", F.explode(F.transform(one, lambda f: F.col("print").bitwiseXOR(f))).alias("at"), F.lit(True).alias("near"))
    large = hot.select("print", F.explode(F.expr(f"transform({pairs_of_bits}, f -> print ^ f)")).alias("at"), F.lit(False).alias("near"))
    ball = small.unionByName(large)
    centre = small.groupBy("at").agg(F.min("print").alias("a"))
    starred = ball.join(centre.hint("merge"), "at").where("a <> print").selectExpr("a", "print b")
    return close.unionByName(starred).selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents(doc_id, text, ...).

    fingerprint: 16 hex digits. component_id: the smallest doc_id that is reachable over links
    of at most three differing bits. Equal fingerprints (copies) are one node, made by a
    pre-aggregated minimum, so a group of copies of any size costs one row; all null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null
    doc_id is linked but never a component's id, unless it has no other. Other columns aren't looked at. Texts of any length are
    hashed 65,536 shingles at a time. An empty table gives no rows. Nothing is broadcast; a fingerprint that a third of all rows share is one node, and its rows are
    divided by the engine's skew join where they get their component.
    """
    tables = Tables(docs.sparkSession)
    prints = tables.write(fingerprints(docs, width, seed))
    nodes = tables.write(prints.groupBy("print").agg(F.min("doc_id").alias("least_doc")))
    parts = connected_components(links(nodes.select("print"), tables), tables)
    named = nodes.join(parts.hint("merge"), nodes.print == parts.node, "left").select("print", "least_doc", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    ids = named.join(least.hint("merge"), "component").select("print", "component_id")
    return prints.join(ids.hint("merge"), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

