"""Packing of token sequences by matching of large items, then best fit of the small ones.

Only lengths matter for a packing, and there are no more of them than the
capacity. So the plan is made from the number of pieces of each length, on
the driver, in a table whose size the capacity bounds; then each piece finds
its place in it by its rank among those of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import byte_bpe
from ._shared import Tables, slices


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((length, first rank, ranks, first bin, offset) rows, number of bins) for counts of lengths.

    Lengths above a third of the capacity are large: no bin holds more than two
    of them. From the largest down, each takes the largest large partner that
    still fits. Smaller ones follow by size, largest first, each into the
    fullest bin that has room, else into a new one. Bins of one state are
    handled together, so the work depends on the capacity and not on the counts.
    """
    left = {n: c for n, c in counts.items() if c and n > 0}
    if any(n > capacity for n in left):
        raise ValueError("a length above the capacity")
    rows: list[tuple[int, int, int, int, int]] = []
    given = dict.fromkeys(left, 0)
    bins = 0
    gaps: list[int] = []  # sorted
    open_bins: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, given[length], n, first, offset))
        given[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in open_bins:
                open_bins[gap] = []
                insort(gaps, gap)
            open_bins[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for k, a in enumerate(large):
        for b in large[k:]:
            if not left[a]:
                break
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a + b <= capacity and n:
                put(a, n, bins, 0)
                put(b, n, bins, a)
                leave(capacity - a - b, bins, n)
                bins += n
        if n := left[a]:
            put(a, n, bins, 0)
            leave(capacity - a, bins, n)
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.pop(at)
            else:
                gap = capacity
                first, n = bins, -(-left[s] // (capacity // s))
                bins += n
            each = gap // s
            full = min(n, left[s] // each)
            for j in range(each if full else 0):
                put(s, full, first, capacity - gap + j * s)
            leave(gap - each * s, first, full)
            if full < n:
                rest = left[s]  # fewer than each
                for j in range(rest):
                    put(s, 1, first + full, capacity - gap + j * s)
                used = 1 if rest else 0
                if used:
                    leave(gap - rest * s, first + full, 1)
                leave(gap, first + full + used, n - full - used)
    return rows, bins


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth) of every document, cut only where longer than the capacity.

    The first piece of a cut document takes the odd rest, the others are full.
    part and nth: the task and the number of earlier pieces of this length in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), byte_bpe(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def batch() -> pa.RecordBatch:
                doc, piece, start, length, ids, nth = out
                return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()), "part": pa.array([part] * len(doc), pa.int32()), "nth": pa.array(nth, pa.int64())})

            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                total = len(ids) // 4
                lo, k = 0, 0
                hi = total % capacity or capacity
                while lo < total:
                    for column, x in zip(out, (doc_id, k, lo, hi - lo, ids[4 * lo : 4 * hi], int(seen[hi - lo]))):
                        column.append(x)
                    seen[hi - lo] += 1
                    lo, hi, k = hi, hi + capacity, k + 1
                if len(out[0]) >= 2000:
                    yield batch()
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield batch()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, carry: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of documents(doc_id, text, ...) with their sequence_id and offset.

    carry: the further columns of the result, computed from ids (the piece as
    little-endian uint32) before anything is shuffled; by default ids itself.

    Null and empty texts are the end id alone. Repeated rows and null doc_ids are
    packed like any other row. Other columns are not looked at. An empty table
    gives no rows. Pieces of a length are ranked by task and then by place in it,
    from counts, so a length that most pieces share is never in one task.
    """
    spark = docs.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    tables = Tables(spark)
    pieces = tables.write(pieces_of(docs, tokenizer, end_id, capacity).select("doc_id", "piece", "start", "length", *(c.alias(k) for k, c in carry.items()), "part", "nth"))
    counts = tables.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    plan, _ = plan_bins({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    plan.sort()
    length, rank, _n, first, offset = (np.array(x, np.int64) for x in zip(*plan)) if plan else [np.zeros(0, np.int64)] * 5
    key = (length << 50) + rank

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", *carry, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (b.column("length").to_numpy(zero_copy_only=False) << 50) + ranks, "right") - 1
            columns = {k: b.column(k) for k in b.schema.names if k != "rank"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(first[at] + ranks - rank[at], pa.int64()), "offset": pa.array(offset[at], pa.int64())})

    kept = ranked.drop("rank").schema
    return ranked.mapInArrow(place, kept.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a pack() that carries ids: each sequence's pieces in place, at most a capacity of them."""
    put = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(put.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
