"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 1,024 bytes. Each passage is encoded from
its bytes (square roots of the shares of bytes and of hashed byte pairs, and how
few different eight-byte runs it has) through one tanh layer. Gated attention, learnt from the
labels of documents alone, weights the passages; the weighted representation is scored by a logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, slices

PASSAGE = 1024
PAIRS = 512
RUNS = 1024
WIDTH = 256 + PAIRS + 4
HIDDEN, GATE = 32, 16
#: Bounds of the sample of labelled rows that the classifier is fitted on: documents of each label, bytes of one document, and bytes of
#: a label's documents together, in the order of their hashes. Of a document in the sample all passages count. Scores have no such bounds.
SAMPLE, SAMPLE_ROW_BYTES, SAMPLE_BYTES = 3000, 1 << 20, 32 << 20
#: Passages that a text, or a group of short texts, is encoded by at a time.
SEGMENT = 400


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text is one empty passage."""
    return _encode([(t or "").encode("utf-8", "surrogatepass") for t in texts])


def _encode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw])
    rows = int(n.sum())
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    b = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size)
    start = np.concatenate([[0], ends[:-1]])
    row = np.arange(len(b), dtype=np.int32)
    row -= np.repeat(start, size).astype(np.int32)
    row >>= 10
    row += np.repeat(first, size).astype(np.int32)
    x = np.zeros((rows, WIDTH), np.float32)
    x[:, :256] = np.bincount(row * np.int32(256) + b if rows < 8_000_000 else row.astype(np.int64) * 256 + b, minlength=rows * 256).reshape(rows, 256)
    length = x[:, :256].sum(1)
    if len(b) > 1:
        pair = (b[:-1].astype(np.int32) * 31 + b[1:]) & (PAIRS - 1)
        within = np.ones(len(pair), bool)  # no pair reaches into the next text
        within[(ends[:-1] - 1)[(ends[:-1] > 0) & (ends[:-1] < len(b))]] = False
        x[:, 256 : 256 + PAIRS] = np.bincount((row[:-1] * np.int32(PAIRS) + pair)[within], minlength=rows * PAIRS).reshape(rows, PAIRS)
    if len(b) >= 8:
        runs = np.lib.stride_tricks.sliding_window_view(b, 8)
        word = np.ascontiguousarray(b).view(np.uint8)
        h = np.zeros(len(runs), np.uint64)
        for k in range(8):
            h = (h << np.uint64(8)) | word[k : k + len(runs)]
        with np.errstate(over="ignore"):
            h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int32)
        within = np.ones(len(runs), bool)
        for k in range(1, 8):
            at = ends - k
            within[at[(at >= 0) & (at < len(runs)) & (ends < len(b))]] = False
        used = np.zeros(rows * RUNS, bool)
        used[(row[: len(runs)] * np.int32(RUNS) + h)[within]] = True
        x[:, 256 + PAIRS] = used.reshape(rows, RUNS).sum(1)
    x[:, 256 + PAIRS + 1] = length
    np.sqrt(x[:, : 256 + PAIRS] / np.maximum(length, 1)[:, None], out=x[:, : 256 + PAIRS])
    expected = RUNS * (1 - np.exp(-length / RUNS))
    x[:, 256 + PAIRS] = 3 * x[:, 256 + PAIRS] / np.maximum(expected, 1)
    x[:, 256 + PAIRS + 1] = length / PASSAGE
    x[:, 256 + PAIRS + 2] = length == 0
    x[:, 256 + PAIRS + 3] = 1
    return x, n


@dataclass
class Model:
    w: np.ndarray  # WIDTH x HIDDEN
    v: np.ndarray  # HIDDEN x GATE
    u: np.ndarray
    a: np.ndarray  # GATE
    c: np.ndarray  # HIDDEN + 1

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        bag = np.repeat(np.arange(len(n)), n)
        h = np.tanh(x @ self.w)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        p = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * p[:, None], first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30)))
        return {"bag": bag, "h": h, "t": t, "s": s, "p": p, "z": z, "y": y, "first": first}

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts of any length, in memory that doesn't grow with it."""
        out, group, size = np.zeros(len(texts)), [], 0
        for k, text in enumerate(texts):
            n = len(text or "")
            if n > SEGMENT * PASSAGE // 4:
                out[k] = self._long(text)
                continue
            if size + n > SEGMENT * PASSAGE and group:
                out[group] = self.forward(*passages([texts[i] for i in group]))["y"]
                group, size = [], 0
            group.append(k)
            size += n
        if group:
            out[group] = self.forward(*passages([texts[i] for i in group]))["y"]
        return out

    def _long(self, text: str) -> float:
        """One text's score by segments: attention's sums are carried with their largest exponent."""
        raw = text.encode("utf-8", "surrogatepass")
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for lo in range(0, len(raw), SEGMENT * PASSAGE):
            own = raw[lo : lo + SEGMENT * PASSAGE]
            x = _encode([raw[lo : lo + len(own) + 7]])[0][: -(-len(own) // PASSAGE)]  # pairs and runs reach up to seven bytes ahead
            h = np.tanh(x @ self.w)
            e = (np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))) @ self.a
            new = max(top, float(e.max()))
            p, old = np.exp(e - new), np.exp(top - new)
            total, z, top = total * old + p.sum(), z * old + p @ h, new
        return float(1 / (1 + np.exp(-np.clip(z / total @ self.c[:-1] + self.c[-1], -30, 30))))


def fit(x: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 40, seed: int = 7, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the weighted log loss of bags."""
    g = np.random.default_rng(seed)
    m = Model(*(g.normal(0, k ** -0.5, s).astype(np.float32) for k, s in ((8, (WIDTH, HIDDEN)), (HIDDEN, (HIDDEN, GATE)), (HIDDEN, (HIDDEN, GATE)), (GATE, GATE), (HIDDEN, HIDDEN + 1))))
    params = [m.w, m.v, m.u, m.a, m.c]
    mean, square, step = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    for epoch in range(epochs):
        order = g.permutation(len(n))
        for lo in range(0, len(n), 128):
            at = order[lo : lo + 128]
            xs = np.concatenate([x[first[k] : first[k] + n[k]] for k in at]).astype(np.float32)
            f = m.forward(xs, n[at])
            dy = ((f["y"] - label[at]) * weight[at] / weight[at].sum()).astype(np.float32)
            dc = np.concatenate([f["z"].T @ dy, [dy.sum()]])
            dz = dy[:, None] * m.c[:-1]
            dh = f["p"][:, None] * dz[f["bag"]]
            dp = (f["h"] * dz[f["bag"]]).sum(1)
            de = f["p"] * (dp - np.add.reduceat(f["p"] * dp, f["first"])[f["bag"]])
            ts = f["t"] * f["s"]
            da = ts.T @ de
            dts = de[:, None] * m.a
            dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
            dv, du = f["h"].T @ dt, f["h"].T @ ds
            dh = (dh + dt @ m.v.T + ds @ m.u.T) * (1 - f["h"] ** 2)
            step += 1
            for q, d, m1, m2 in zip(params, (xs.T @ dh, dv, du, da, dc), mean, square):
                d = d + decay * q
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                q -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, training: Column, per_label: int = SAMPLE, row_bytes: int = SAMPLE_ROW_BYTES, label_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on a bounded sample of the labelled rows where training holds: per label those with the smallest hashes of doc_id.

    At most per_label rows of a label, of which those of more than row_bytes and what goes beyond label_bytes in all are left out; the
    others count with all their passages. The sample is weighted back to the labels' shares. Labels other than 0 and 1 and doc_ids that are null are left out;
    repeated labels count once, the smallest. None if there are no labelled rows.
    """
    from pyspark.sql import Window

    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id").where(training)
    totals = {r.quality: r.n for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [ids.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in totals]
    if not chosen:
        return None
    sample = chosen[0].unionByName(chosen[1]) if len(chosen) > 1 else chosen[0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc_id, text, quality in zip(*(b.column(k).to_pylist() for k in range(3))):
                x, _ = passages([text])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "quality": pa.array([quality], pa.int32()), "x": pa.array([x.astype(np.float16).tobytes()], pa.binary())})

    # one text of each doc_id: the smallest
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("k = 1")
    bytes_before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    one = one.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= row_bytes).withColumn("bytes", bytes_before).where(F.col("bytes") <= label_bytes)
    rows = one.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(encode, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return None
    label = np.array([r.quality for r in rows], np.float32)
    n = np.array([len(r.x) // (2 * WIDTH) for r in rows])
    x = np.concatenate([np.frombuffer(r.x, np.float16).reshape(-1, WIDTH) for r in rows])  # stays in half precision but for the batch at hand
    del rows
    share = {q: totals[q] / max(1, int((label == q).sum())) for q in totals}
    return fit(x, n, label, np.array([share[int(q)] for q in label], np.float32))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns to keep and score (under the given name), the chance of label 1, for each row of documents(text, ...), from the whole of its text alone.

    Null and empty texts have one empty passage; long ones are encoded by segments, so memory doesn't grow with a text. Repeated rows and null doc_ids give rows of their own;
    an empty table gives none. Without a model all scores are 0.5.
    """
    schema = docs.select(*keep).schema.add(name, "double")
    own = "text" in keep
    at = keep.index("text") if own else 0
    sent = docs.select(*keep) if own else docs.select(F.col("text").alias(fresh(list(keep), "text")), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            made = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[0 if own else 1 :], pa.array(made.astype(float), pa.float64())], names=[*keep, name])

    return sent.mapInArrow(run, schema)


def held_out(remainder: int = 1, folds: int = 3) -> Column:
    """crc32 of the doc_id as text, mod folds, is the remainder; a null doc_id counts as the empty string."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % folds == remainder


__all__ = ["Model", "fit", "held_out", "learn", "passages", "score"]
