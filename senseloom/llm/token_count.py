"""Token counts with a shortcut for whole tokens.

A vocabulary string that the library itself encodes as one token needs no
merging: where a pre-token of a text is such a string, it counts one. Which
strings are such is proved once for a vocabulary, offline, by encoding each of
them alone; byte-pair merging of a pre-token depends on nothing but the pre-token,
so what holds alone holds in any text. The rest are merged by the library, each
distinct one once while it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: White space beyond that of plain texts, or a character that lower-casing or composition may treat by its neighbours.
_ODD = re.compile("[^\n\x20-\x7e¡-ÿ]")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
_PLAIN = re.compile("[a-zß-öø-ÿ]+[.,]?")
LONGEST_KEPT = 64


class _Known(dict):
    def __init__(self, find):
        self.find = find

    def __missing__(self, key):
        n = self.find(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = n
        return n


class WordBpe:
    """count(text): the number of tokens that the library gives for the text.

    Plain texts (printable Latin-1 and newlines) are lower-cased, cut at white
    space and counted part by part; neither lower-casing, composition nor the
    pattern of the pre-tokens reaches over white space there. Other texts, and those that
    hold a special string, go to the library whole.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.single = self.proved()
        self.known, self.merged = _Known(self.part), _Known(self.pretoken)

    def proved(self) -> frozenset[str]:
        """Pre-tokens, in the model's letters, that merge into one token: found by merging each vocabulary string."""
        ends = [w[:-4] for w in self.tokenizer.get_vocab() if w.endswith("</w>") and w not in self.special]
        return frozenset(w for w in ends if len(self.model.tokenize(w)) == 1)

    def pretoken(self, word: str) -> int:
        at = word.encode().decode("latin-1").translate(self.letters)
        return 1 if at in self.single else len(self.model.tokenize(at))

    def part(self, part: str) -> int:
        if _PLAIN.fullmatch(part):
            if part[-1] in ".,":
                return self.merged[part[:-1]] + self.merged[part[-1]]
            return self.pretoken(part)
        return sum(map(self.merged.__getitem__, _WORDS.findall(part)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _ODD.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > self.most:
            self.known.clear()
            self.merged.clear()
        return sum(map(self.known.__getitem__, text.lower().split()))


_loaded: dict[str, WordBpe] = {}


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of documents(doc_id, text, ...), whatever the length of its text.

    A null or empty text has 0 and 0. Null doc_ids and repeated rows give rows of
    their own; other columns are not looked at; an empty table gives no rows. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordBpe(tokenizer)
        of = _loaded[tokenizer].count
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array([of(x) for x in texts], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
