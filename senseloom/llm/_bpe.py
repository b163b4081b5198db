"""Encoding of whole texts by the tokenizers library, each distinct piece of text once.

A text is cut where one space stands between two characters that aren't white
space. No pre-token of the byte-level pattern reaches over such a place, as
only its runs of white space hold a space elsewhere than in front; so the ids
of the parts, each with its space in front, make up the ids of the text.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(f" ?[!-~{_LETTERS}]+(?:\n[!-~{_LETTERS}]+)*")
_PRE_TOKENS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|\n")
#: Longer parts aren't kept.
LONGEST_KEPT = 64


def parts_of(text: str) -> list[str]:
    """The first part as it stands; each other one without the space in front of it."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return _CUT.split(text)
    return text.split(" ")


class _Known(dict):
    def __init__(self, find):
        self.find = find

    def __missing__(self, part):
        ids = self.find(part)
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids


class ByteBpe:
    """ids(text): the library's ids as little-endian unsigned 32-bit integers.

    most: parts kept between documents; beyond it the store starts anew.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are written as this machine's unsigned integers")

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.words = _Known(self.pre_token)
        self.known = _Known(lambda part: self.part(" " + part))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pre_token(self, word: str) -> bytes:
        at = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(at)]).tobytes()

    def part(self, part: str) -> bytes:
        """Pre-tokens of plain Latin-1 are found here and merged by the library's model; all else is the library's."""
        if len(part) > LONGEST_KEPT or not _SIMPLE.fullmatch(part):
            return self.whole(part)
        found = _PRE_TOKENS.findall(part)
        if len(found) == 1:
            return self.pre_token(found[0])  # kept as a part already
        return b"".join(map(self.words.__getitem__, found))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        if len(self.known) > self.most:
            self.known.clear()
            self.words.clear()
        first, *rest = parts_of(text)
        return self.part(first) + b"".join(map(self.known.__getitem__, rest))


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process and path."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
