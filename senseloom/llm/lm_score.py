"""Language-model scores from a subword lattice.

A text is a sequence of words (ASCII letters lower-cased, cut at ASCII white space) and one
end. Each word is spelled by the pieces of an existing unigram vocabulary, the first with the word mark. All segmentations
count: the probability of a word is their sum, weighted by the scores of the vocabulary, by a
forward recursion in log space. As no piece reaches over a word mark,
the marginal probability of a document is the product over its words, so the
recursion runs once for each distinct word of the corpus and not for each of its places.

From the training texts come the share of ends among the tokens, and a correction of the scores, as the vocabularies at hand are of merges
and their scores mere ranks: by expectation-maximisation, the expected uses of the pieces over all segmentations, which the
vocabulary's scores weight, are added to a prior in proportion to these scores.

The most frequent words, of bounded number and bytes, are looked up by the tasks that read the
texts; the rest are joined with the word table by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, slices

MARK = "▁"
#: Words sent to every task, the most frequent first: their number and their bytes in all, at most.
HEAD, HEAD_BYTES = 100_000, 8 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
_LOW = -1e30
_BEGUN, _NONE = -1, -2


class Lattice:
    """Pieces with log weights; words(texts) gives the log marginal probability of each word."""

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_pieces: dict[int, int]):
        self.pieces, self.byte_pieces = pieces, byte_pieces
        self.logp = scores
        self.longest = max((len(p) for p in pieces), default=1)
        self.chars = {c for p in pieces if len(p) == 1 for c in p}
        # every beginning of a piece has a key, as what begins no piece needn't be looked up any further
        begun = {p[:k]: _BEGUN for p in pieces for k in range(1, len(p))}
        plain = set(range(len(pieces))) - set(byte_pieces.values())
        own = {pieces[k]: k for k in sorted(plain)}
        if len(own) != len(plain):
            raise ValueError("two pieces are the same")
        begun |= own
        keys, at = self._hashes([*begun]), np.array([*begun.values()], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], at[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a key")
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slot = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    _M = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def _mix(cls, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c.astype(np.uint64)) * cls._M
        return h ^ (h >> np.uint64(29))

    @classmethod
    def _hashes(cls, strings: list[str]) -> np.ndarray:
        n = np.array([len(x) for x in strings], np.int64)
        c = np.array(strings, f"<U{max(1, n.max(initial=1))}").view(np.uint32).reshape(len(strings), -1)
        h = np.zeros(len(strings), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(c.shape[1]):
                h = np.where(n > j, cls._mix(h, c[:, j]), h)
            return (h ^ (h >> np.uint64(32))) * cls._M

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each key, _BEGUN if it is only the beginning of one, or _NONE."""
        k = (h ^ (h >> np.uint64(32))) * self._M
        top = (k >> self.shift).astype(np.int64)
        lo, hi = self.slot[top], self.slot[top + 1]
        out = np.full(len(k), _NONE, np.int64)
        live = np.flatnonzero(lo < hi)
        for _ in range(16):
            if not len(live):
                break
            at = lo[live]
            same = self.keys[at] == k[live]
            out[live[same]] = self.ids[at[same]]
            lo[live] += 1
            live = live[~same & (at + 1 < hi[live])]
        else:
            raise RuntimeError("crowded keys")
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """For words of at most 64 characters: lengths with the mark, by (start, end) the words and pieces that have an arc, and the weight of spelling out characters without a piece."""
        marked = [MARK + w for w in words]
        n = np.array([len(w) for w in marked], np.int64)
        width = int(n.max())
        c = np.array(marked, f"<U{width}").view(np.uint32).reshape(len(words), width).T.copy()
        found = {}
        with np.errstate(over="ignore"):
            for i in range(width):
                live = np.flatnonzero(n > i)
                h = np.zeros(len(live), np.uint64)
                for j in range(i + 1, min(width, i + self.longest) + 1):
                    keep = n[live] >= j
                    if not keep.all():
                        live, h = live[keep], h[keep]
                    if not len(live):
                        break
                    h = self._mix(h, c[j - 1][live])
                    piece = self._find(h)
                    hit = piece >= 0
                    if j == i + 1 and not hit.all():  # a character without a piece is spelled in bytes
                        missing = live[~hit]
                        spelled = np.array([-2 - int(x) for x in c[i][missing]], np.int64)
                        found[i, j] = (np.concatenate([live[hit], missing]), np.concatenate([piece[hit], spelled]))
                    elif hit.any():
                        found[i, j] = (live[hit], piece[hit])
                    more = piece != _NONE
                    live, h = live[more], h[more]
        return n, found

    def weight(self, piece: np.ndarray) -> np.ndarray:
        out = self.logp[np.maximum(piece, 0)]
        for k in np.flatnonzero(piece < -1):
            out[k] = sum(self.logp[self.byte_pieces[b]] for b in chr(-2 - int(piece[k])).encode("utf-8", "surrogatepass"))
        return out

    def forward(self, n: np.ndarray, found: dict) -> tuple[np.ndarray, dict]:
        """Log forward sums by place (place, word), and the weights of the arcs."""
        width = int(n.max())
        a = np.full((width + 1, len(n)), _LOW)
        a[0] = 0.0
        weights = {k: self.weight(p) for k, (_, p) in found.items()}
        by_end: dict[int, list[int]] = {}
        for i, j in found:
            by_end.setdefault(j, []).append(i)
        for j in range(1, width + 1):
            for i in by_end.get(j, []):
                rows = found[i, j][0]
                a[j][rows] = np.logaddexp(a[j][rows], a[i][rows] + weights[i, j])
        return a, weights

    def words(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        short = [k for k, w in enumerate(words) if len(w) < 64]
        for group in self._groups(words, short):
            n, found = self.arcs([words[k] for k in group])
            a, _ = self.forward(n, found)
            out[group] = a[n, np.arange(len(group))]
        for k in set(range(len(words))) - set(short):
            out[k] = self._long(words[k])[0]
        return out

    @staticmethod
    def _groups(words: list[str], of: list[int], most: int = 20_000) -> Iterator[list[int]]:
        sizes = np.array([len(words[k]) for k in of], np.int64)
        order = np.argsort(sizes, kind="stable")
        sizes, lo = sizes[order], 0
        while lo < len(of):
            hi = min(lo + most, int(np.searchsorted(sizes, sizes[lo] + 2, "right")))
            yield [of[k] for k in order[lo:hi].tolist()]
            lo = hi

    def _long(self, word: str) -> tuple[float, list]:
        """The same recursion, one place after the other, for a word of any length."""
        if not hasattr(self, "index"):
            self.index = {self.pieces[k]: k for k in self.ids.tolist() if k >= 0}
        s = MARK + word
        a = np.full(len(s) + 1, -np.inf)
        a[0] = 0.0
        arcs = []
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.index.get(s[i:j])
                if k is None and i == j - 1:
                    k = -2 - ord(s[i])
                if k is not None:
                    w = float(self.weight(np.array([k]))[0])
                    a[j] = np.logaddexp(a[j], a[i] + w)
                    arcs.append((i, j, k, w))
        return float(a[-1]), [a, arcs]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations of the words, times their counts."""
        use = np.zeros(len(self.pieces))

        def add(pieces: np.ndarray, amount: np.ndarray) -> None:
            real = pieces >= 0
            use[:] += np.bincount(pieces[real], amount[real], len(use))
            for k in np.flatnonzero(pieces < -1):
                for b in chr(-2 - int(pieces[k])).encode("utf-8", "surrogatepass"):
                    use[self.byte_pieces[b]] += amount[k]

        short = [k for k, w in enumerate(words) if len(w) < 64]
        for group in self._groups(words, short):
            n, found = self.arcs([words[k] for k in group])
            a, weights = self.forward(n, found)
            width, c = int(n.max()), counts[group]
            total = a[n, np.arange(len(group))]
            b = np.full((width + 1, len(group)), _LOW)
            b[n, np.arange(len(group))] = 0.0
            for i, j in sorted(found, key=lambda x: -x[0]):
                rows = found[i, j][0]
                b[i][rows] = np.logaddexp(b[i][rows], b[j][rows] + weights[i, j])
            amounts = [c[rows] * np.exp(np.minimum(0.0, a[i][rows] + weights[i, j] + b[j][rows] - total[rows])) for (i, j), (rows, _) in found.items()]
            add(np.concatenate([pieces for _, pieces in found.values()]), np.concatenate(amounts))
        for k in set(range(len(words))) - set(short):
            total, (a, arcs) = self._long(words[k])
            b = np.full(len(a), -np.inf)
            b[-1] = 0.0
            for i, j, piece, w in sorted(arcs, key=lambda x: -x[1]):
                b[i] = np.logaddexp(b[i], b[j] + w)
            for i, j, piece, w in arcs:
                add(np.array([piece]), counts[k] * np.exp(np.array([a[i] + w + b[j] - total])))
        return use


def vocabulary(path: str) -> Lattice:
    """The pieces of a sentencepiece vocabulary, weighted by its own scores (ranks, for a vocabulary of merges)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(k) for k in range(n)]
    byte = {int(pieces[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
    scores = np.array([sp.get_score(k) for k in range(n)])
    if scores.min() < -100:  # ranks: by Zipf's law
        scores = -np.log(2.7 - np.minimum(scores, 0))
    scores = np.where([sp.is_control(k) or sp.is_unknown(k) for k in range(n)], _LOW, scores)
    scores[list(byte.values())] = scores[scores > _LOW].min()
    keep = [k for k in range(n) if scores[k] > _LOW and MARK not in pieces[k][1:]]
    at = {k: i for i, k in enumerate(keep)}
    return Lattice([pieces[k] for k in keep], scores[keep] - np.logaddexp.reduce(scores[keep]), {b: at[k] for b, k in byte.items()})


_loaded: dict[str, Lattice] = {}


def _lattice(path: str, logp: np.ndarray | None) -> Lattice:
    if path not in _loaded:
        _loaded[path] = vocabulary(path)
    lattice = _loaded[path]
    if logp is not None:
        lattice.logp = logp
    return lattice


def tokens(text: str | bytes | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    return crc32(str("" if doc_id is None else doc_id).encode()) % folds == 0


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of all texts with its count in the training texts (0: in none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = [*seen[0], *seen[1]]
            c = [*seen[0].values(), *([0] * len(seen[1]))]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "c": pa.array(c, pa.int64())})

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                seen[held_out(doc_id)].update(tokens(text))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield out()
        if seen[0] or seen[1]:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, vocabulary_path: str, rounds: int = 2, smooth: float = 0.1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of documents(doc_id, text, ...).

    Trained on the rows whose crc32(doc_id as text) mod 10 isn't 0. base_score: sum of
    log10 of the add-smooth word probability; score: the log10 marginal probability of the text through the lattice.
    rounds: of the correction of the vocabulary's scores; with none they weight the lattice as they are.

    A null or empty text is its end alone. A null doc_id counts as the empty string and is held out. Repeated
    rows are counted, and scored, as often as they come. Other columns aren't looked at. Without
    training texts all words are unknown, the scores are the vocabulary's and an end is as likely as a word.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    counted = tables.write(count_words(docs))
    ends = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d")).where("crc32(encode(d, 'utf-8')) % 10 <> 0").count()
    sums = counted.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums.n or 0) + ends, sums.v + (1 if ends else 0)

    own = _lattice(vocabulary_path, None).logp.copy()
    logp = own
    for _ in range(rounds if sums.v else 0):

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            lattice = _lattice(vocabulary_path, logp)
            use = np.zeros(len(lattice.pieces))
            for b in batches:
                use += lattice.expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float))
            at = np.flatnonzero(use)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "uses": pa.array(use[at], pa.float64())})

        got = counted.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # as many rows as the vocabulary has pieces
        use = len(own) * np.exp(own)  # the prior: one use for each piece on average
        for r in got:
            use[r.piece] += r.uses
        logp = np.log(use / use.sum())
    end_share = (ends + smooth) / (n + 2 * smooth)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary_path, logp)
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_pydict({
                "word": b.column(0), "c": b.column(1),
                "base": pa.array(np.log10((c + smooth) / (n + smooth * (v + 1)))),
                "lp": pa.array((lattice.words(b.column(0).to_pylist()) + np.log1p(-end_share)) / np.log(10)),
            })

    rated = tables.write(counted.mapInArrow(rate, "word string, c long, base double, lp double"))
    head, rates, size = {}, [], 0
    for r in rated.where(F.octet_length("word") <= HEAD_BYTES // 128).orderBy(F.desc("c"), "word").limit(HEAD).toLocalIterator():
        word = r.word.encode("utf-8", "surrogatepass")
        size += len(word)
        if size > HEAD_BYTES:
            break
        head[word] = len(head)
        rates.append((float(r.c > 0), r.base, r.lp))
    sent = spark.sparkContext.broadcast((head, np.array(rates, np.float64).reshape(-1, 3).T.copy()))
    end = (int(ends > 0), float(np.log10((ends + smooth) / (n + smooth * (v + 1)))), float(np.log10(end_share)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_rates = sent.value
        for b in slices(batches, 64):
            rid, words, k, sizes, lengths = b.column(0).to_numpy(), [], [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                all_words = tokens(text)
                seen = Counter(all_words)
                words += seen
                k += seen.values()
                sizes.append(len(seen))
                lengths.append(len(all_words) + 1)
            k, row = np.array(k, np.int64), np.repeat(np.arange(len(rid)), sizes)
            at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            far = at < 0
            some, base, lp = (x + np.bincount(row[~far], k[~far] * rate[at[~far]], len(rid)) for x, rate in zip(end, known_rates))
            row = np.concatenate([row[far], np.arange(len(rid))])
            none = np.zeros(len(row) - len(rid))
            # a word holds no blank, so a text's own key meets none and spreads the rows
            keys = pa.array([*compress(words, far.tolist()), *(b" %d" % r for r in rid.tolist())], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "rid": pa.array(rid[row]), "doc_id": b.column(1).take(pa.array(row)), "word": keys.cast(pa.string()),
                "k": pa.array(np.concatenate([k[far], np.zeros(len(rid), np.int64)])), "n_tokens": pa.array(np.concatenate([none, lengths]).astype(np.int64)),
                "n_known": pa.array(np.concatenate([none, some]).astype(np.int64)), "base0": pa.array(np.concatenate([none, base])), "lp0": pa.array(np.concatenate([none, lp])),
            })

    looked = tables.write(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, "rid long, doc_id long, word string, k long, n_tokens long, n_known long, base0 double, lp0 double"))  # written, as the numbers of rows must not change
    part = looked.join(rated, "word", "left").select(
        "rid", "doc_id", "n_tokens",
        (F.col("n_known") + F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_known"),
        (F.col("base0") + F.coalesce(F.col("base") * F.col("k"), F.lit(0.0))).alias("base"),
        (F.col("lp0") + F.coalesce(F.col("lp") * F.col("k"), F.lit(0.0))).alias("lp"),
    )
    sums = part.groupBy("rid", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
    out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 10 == 0
    return sums.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
