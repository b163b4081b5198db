"""Token ids in directly addressable files.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th
chunks of all ids that have one, side by side, and a bitmap that tells which of
them goes on at level k+1. The place of its next chunk is the number of set
bits before it, which a directory of counts for every 512 bits gives with a
look at no more than 64 bytes. So any token is read with one probe a level and
no block is decoded.

Layout of a file: the magic "DAC1", an unsigned 64-bit length, a JSON header of that
length with the name, type, place and number of each array, then the arrays:
doc_id, doc_null, offset (first token of each document and the end) and, by
level, chunk (uint8), more (bitmap, little bit order), rank (uint64 counts).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import byte_bpe
from ._shared import delete, shared_folder, slices

MAGIC = b"DAC1"
DIRECTORY = 512


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) for each level of the given ids."""
    levels, rest = [], np.asarray(ids, "<u4")
    while True:
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ends = np.add.reduceat(more, np.arange(0, len(more), DIRECTORY), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate([np.zeros(1, "<u8"), np.cumsum(ends, dtype="<u8")])
        levels.append((chunk, bits, rank))
        if not more.any():
            return levels
        rest = rest[more]


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    arrays = {
        "doc_id": np.array([x or 0 for x in doc_ids], "<i8"),
        "doc_null": np.array([x is None for x in doc_ids], np.uint8),
        "offset": np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"),
    }
    levels = encode_levels(ids)
    for k, level in enumerate(levels):
        arrays |= {f"{name}{k}": a for name, a in zip(("chunk", "more", "rank"), level)}
    head, at = {"tokens": len(ids), "levels": len(levels), "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = [a.dtype.str, at, len(a)]
        at += a.nbytes
    text = json.dumps(head).encode()
    return b"".join([MAGIC, np.uint64(len(text)).astype("<u8").tobytes(), text, *(a.tobytes() for a in arrays.values())])


class TokenFile:
    """Random access to one file: token(i), document(k), all_ids()."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(data, "<u8", 1, 4)[0])
        head = json.loads(bytes(data[12 : 12 + n]))
        self.tokens, self.levels = head["tokens"], head["levels"]
        self.a = {k: np.frombuffer(data, t, c, 12 + n + at) for k, (t, at, c) in head["arrays"].items()}

    def token(self, i: int) -> int:
        """The i-th id, from one chunk a level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k in range(self.levels):
            out |= int(self.a[f"chunk{k}"][i]) << (8 * k)
            bits = self.a[f"more{k}"]
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            block = i // DIRECTORY
            here = np.unpackbits(bits[block * DIRECTORY // 8 : (i >> 3) + 1], bitorder="little")[: i - block * DIRECTORY]
            i = int(self.a[f"rank{k}"][block]) + int(here.sum())
        return out

    def all_ids(self) -> np.ndarray:
        where, out = None, self.a["chunk0"].astype("<u4")
        for k in range(1, self.levels):
            count = len(self.a[f"chunk{k - 1}"])
            more = np.flatnonzero(np.unpackbits(self.a[f"more{k - 1}"], count=count, bitorder="little"))
            where = more if where is None else where[more]
            out[where] |= self.a[f"chunk{k}"].astype("<u4") << (8 * k)
        return out

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.a["offset"][k]), int(self.a["offset"][k + 1])
        return np.array([self.token(i) for i in range(a, b)], "<u4")


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, tokens_per_file: int = 4_000_000) -> DataFrame:
    """Encode documents(doc_id, text, ...) and write them in ascending doc_id order; returns the manifest.

    Manifest: part, seq, path, n_docs, n_tokens, start (tokens in all files before).
    Documents are put in order by a range partitioning of the text, each task
    encodes its own and rolls its file at tokens_per_file, so its memory is
    bounded by that and its longest document. A file appears under its name by
    one rename; a task that is run again writes files of its own, and
    the manifest names those of the attempt that was committed.

    Null and empty texts have the end id alone. A null doc_id sorts first and is
    read back as null. Repeated rows are written as often as they come, ties in
    text order. Other columns are not looked at. An empty table has no files.
    """
    spark = docs.sparkSession
    folder = _uri(folder or shared_folder(spark))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), byte_bpe(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        held: tuple[list, list, list] = ([], [], [])
        seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"{base}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            ids = np.frombuffer(b"".join(held[2]), "<u4")
            with fs.open_output_stream(name + ".part") as f:
                f.write(file_bytes(held[0], held[1], ids))
            fs.move(name + ".part", name)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "n_docs": pa.array([len(held[0])], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
            held, seq = ([], [], []), seq + 1
            return row

        size = 0
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                held[0].append(doc_id)
                held[1].append(len(ids) // 4)
                held[2].append(ids)
                size += len(ids) // 4
                if size >= tokens_per_file:
                    yield flush()
                    size = 0
        if held[0]:
            yield flush()

    # rows of one id, or without any, are many partitions' if need be: beginnings of texts stand in the order of the texts
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long")
    made.write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(made.schema).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files that the manifest names; ids as little-endian uint32."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, _ = _filesystem(row["folder"])
                with fs.open_input_file(row["path"]) as f:
                    t = TokenFile(f.read())
                ids, offset = t.all_ids(), t.a["offset"]
                for lo in range(0, len(offset) - 1, 512):
                    hi = min(lo + 512, len(offset) - 1)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(t.a["doc_id"][lo:hi], pa.int64(), mask=t.a["doc_null"][lo:hi].astype(bool)),
                        "start": pa.array(offset[lo:hi].astype(np.int64) + row["start"], pa.int64()),
                        "ids": pa.array([ids[offset[k] : offset[k + 1]].tobytes() for k in range(lo, hi)], pa.binary()),
                    })

    return manifest.select("path", "start", "folder").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def remove(folder: str, spark: SparkSession) -> None:
    delete(spark, folder)


__all__ = ["TokenFile", "encode_levels", "file_bytes", "read_tokens", "remove", "write_tokens"]
