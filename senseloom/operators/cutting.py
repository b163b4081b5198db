"""Tokens, sentences and runs of tokens of texts as Arrow columns: many texts at a time, by array operations on their code points."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at a time (a longer text is one such part).
PART = 1 << 20
SPACE, WORD = 1, 2


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@cache
def classes() -> np.ndarray:
    """Of each code point: white space (of ASCII), a letter or number, or neither."""
    table = np.fromiter((WORD if unicodedata.category(chr(c))[0] in "LN" else 0 for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    return table


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PART bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
        yield lo, hi
        lo = hi


class Cut:
    """The tokens of some texts: row (of the text), start and end (code points within it), tok (from 1) as arrays, texts by slices()."""

    def __init__(self, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        self.rows = len(texts)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.data = np.frombuffer(whole.encode(), np.uint8)
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        self.at = np.concatenate([[0], np.cumsum(size)])  # bytes before each code point
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = classes()[points]
        new = np.ones(len(points), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        new[first[:-1][first[:-1] < len(points)]] = True
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(points)) if len(lo) else lo
        row = np.searchsorted(first, lo, "right") - 1
        gap = kind[lo] == SPACE
        mine = np.flatnonzero(~gap)
        none = len(lo)
        ahead, behind = np.minimum(mine + 1, none - 1), np.maximum(mine - 1, 0)
        self._after = np.where((mine + 1 < none) & gap[ahead] & (row[ahead] == row[mine]), mine + 1, none)
        self._before = np.where((mine > 0) & gap[behind] & (row[behind] == row[mine]), mine - 1, none)
        self._pieces = lo, hi, mine
        self.row, self.lo, self.hi = row[mine], lo[mine], hi[mine]
        self.start, self.end = self.lo - first[self.row], self.hi - first[self.row]
        self.count = np.bincount(self.row, minlength=self.rows)
        self.of_row = np.concatenate([[0], np.cumsum(self.count)])  # tokens of the texts before
        self.tok = np.arange(len(mine)) - self.of_row[self.row] + 1
        self.followed = self._after != none

    def values(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """value, before and after of each token."""
        lo, hi, mine = self._pieces
        ends = self.at[np.append(lo, [hi[-1], hi[-1]] if len(lo) else [0, 0])].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(self.data))
        return tuple(pieces.take(pa.array(i)) for i in (mine, self._before, self._after))

    def sentence(self) -> np.ndarray:
        """The sentence of each token: a new one begins after . ! or ? that white space follows."""
        lead = self.data[self.at[self.lo]] if len(self.lo) else np.zeros(0, np.uint8)
        stop = np.isin(lead, np.frombuffer(b".!?", np.uint8)) & self.followed
        before = np.concatenate([[0], np.cumsum(stop)])
        return before[:-1] - before[self.of_row[self.row]]

    def slices(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The texts between code points lo and hi; they may overlap."""
        lo, hi = self.at[lo], self.at[hi]
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        index = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)
        return pa.StringArray.from_buffers(len(lo), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[index]))

    def runs(self, k: int) -> np.ndarray:
        """The first tokens of all runs of k tokens of a text."""
        i = np.arange(len(self.row) - k + 1) if len(self.row) >= k else np.zeros(0, np.int64)
        return i[self.row[i] == self.row[i + k - 1]]


def cuts(batches: Iterator[pa.RecordBatch], make, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """make(cut) gives, for the texts in the last column, their rows and the new columns; the columns before go along."""
    for b in batches:
        schema = pa.schema([*list(b.schema)[:-1], *fields])
        for lo, hi in parts(b.columns[-1]):
            part = b.slice(lo, hi - lo)
            row, columns = make(Cut(part.columns[-1]))
            if len(row):
                keys = [c.take(pa.array(row)) for c in part.columns[:-1]]
                new = [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([*keys, *new], schema=schema)


def rows_of(cut: Cut, sentence: bool):
    value, before, after = cut.values()
    more = [cut.sentence()] if sentence else []
    return cut.row, [cut.tok, cut.start, cut.end, value, before, after, *more]


def arrays_of(cut: Cut):
    value, before, after = cut.values()
    each = pa.StructArray.from_arrays([pa.array(cut.start), pa.array(cut.end), value, before, after], ["start", "end", "value", "before", "after"])
    return np.arange(cut.rows), [pa.ListArray.from_arrays(pa.array(cut.of_row.astype(np.int32)), each)]


def sentences_of(cut: Cut):
    """One row for each sentence: its number, start and end, and the values of its tokens."""
    sentence = cut.sentence()
    new = np.ones(len(sentence), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (cut.row[1:] != cut.row[:-1])
    i = np.flatnonzero(new)
    ends = np.append(i, len(sentence)).astype(np.int32)
    return cut.row[i], [sentence[i], cut.start[i], cut.end[ends[1:] - 1], pa.ListArray.from_arrays(pa.array(ends), cut.values()[0])]


def spans_of(cut: Cut, longest: int, forms: bool):
    """All runs of up to longest tokens, gaps included; with forms, the values of their tokens too."""
    firsts = [cut.runs(k) for k in range(1, longest + 1)]
    i, k = np.concatenate(firsts), np.repeat(np.arange(longest), [len(f) for f in firsts])
    columns = [cut.start[i], cut.end[i + k], cut.slices(cut.lo[i], cut.hi[i + k])]
    if forms:
        ends = np.concatenate([[0], np.cumsum(k + 1)])
        index = np.arange(ends[-1]) + np.repeat(i - ends[:-1], k + 1)
        columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cut.values()[0].take(pa.array(index))))
    return cut.row[i], columns


def word_runs(batches: Iterator[pa.RecordBatch], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """(key, run) for the words and pairs of words of the texts in the last column, each once for PART * 16 bytes of text."""
    for b in batches:
        schema = pa.schema([*list(b.schema)[:-1], *fields])
        held, size = [], 0
        for lo, hi in parts(b.columns[-1]):
            part = b.slice(lo, hi - lo)
            texts = [t or "" for t in part.columns[-1].to_pylist()]
            whole = "\n".join(texts)
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            edge = np.diff(letters()[points].astype(np.int8), prepend=0, append=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            row = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), start, "right") - 1
            size8 = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
            at = np.concatenate([[0], np.cumsum(size8)])
            ends = np.empty(2 * len(start) + 1, np.int32)
            ends[0:-1:2], ends[1::2], ends[-1] = at[start], at[end], at[-1]
            pieces = pa.StringArray.from_buffers(2 * len(start), pa.py_buffer(ends), pa.py_buffer(whole.encode()))
            words = pieces.take(pa.array(np.arange(0, 2 * len(start), 2)))
            two = np.flatnonzero(row[1:] == row[:-1])
            pairs = pc.binary_join_element_wise(words.take(pa.array(two)), words.take(pa.array(two + 1)), " ")
            rows = pa.array(np.concatenate([row, row[two]]))
            held.append(pa.Table.from_arrays([*(c.take(rows) for c in part.columns[:-1]), pa.concat_arrays([words, pairs])], schema=schema).group_by(schema.names, use_threads=False).aggregate([]))
            size += 1
            if size == 16:
                yield from pa.concat_tables(held).group_by(schema.names, use_threads=False).aggregate([]).select(schema.names).cast(schema).to_batches(max_chunksize=1 << 17)
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).group_by(schema.names, use_threads=False).aggregate([]).select(schema.names).cast(schema).to_batches(max_chunksize=1 << 17)
