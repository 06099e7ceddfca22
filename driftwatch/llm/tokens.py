"""Token ids of whole texts with the ``tokenizers`` library.

A vocabulary of merges never merges across the library's own pre-tokens, so a
text may be cut wherever a pre-token surely ends, and each different piece
needs encoding once. ``Encoder`` cuts at single blanks, keeps the ids of pieces
seen before (a bounded table), and joins them:

* ``blanks="drop"``: the tokenizer drops blanks; a text is cut at every blank
  and line feed.
* ``blanks="lead"``: byte-level; a blank before a word belongs to the word. A
  text is cut before each blank, and around each line feed, that stands alone
  between two other characters; longer runs of blanks stay inside a piece.

New pieces that are a plain word with at most one mark behind it go straight to
the library's merges (``Tokenizer.model``), all others through its whole
pipeline (``Tokenizer.encode``). Tests hold the result against the library's
encoding of whole texts.
"""
from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

#: Pieces of one generation. Two generations are kept per worker (some 150 MB):
#: when the newer is full it becomes the older, and what is met again moves on.
KEPT = 400_000
LONGEST_KEPT = 64
_ALONE = re.compile(r"(?<=\S)(?= \S)")
_MARKS = ".,;:!?"


def _single_blanks(text: str) -> bool:
    """Whether all white space is blanks and line feeds, each alone between two other characters."""
    words = text.split()
    white = len(text) - len("".join(words))
    return white == len(words) - 1 and white == text.count(" ") + text.count("\n")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies name bytes: printable ones
    stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Pieces(dict):
    """piece -> little-endian unsigned 32-bit ids."""

    def __init__(self, owner: "Encoder", lead: str):
        super().__init__()
        self.owner, self.lead, self.older = owner, lead, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.owner.piece(piece, self.lead)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    def __init__(self, path: str, blanks: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blanks, self.lower = blanks, lower
        self.letters = _byte_letters()
        self.lead = self.letters[32]
        self.first = _Pieces(self, "")
        self.rest = _Pieces(self, " ") if blanks == "lead" else self.first

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _is_word(self, core: str, word: str) -> bool:
        """Letters of scripts on whose properties all Unicode versions agree, in normal form."""
        return (core.isalpha() and word.isalpha() and max(core) < "\u0530" and "\u03a3" not in core
                and unicodedata.is_normalized("NFC", core))

    def piece(self, piece: str, lead: str) -> bytes:
        if not piece and not lead:
            return b""
        core, mark = (piece[:-1], piece[-1]) if piece[-1:] in _MARKS else (piece, "")
        if core and len(core) <= LONGEST_KEPT:
            word = core.lower() if self.lower else core
            if core.isascii():
                if core.isalpha():
                    return self._merged(self.lead + word if lead else word) + (self.first[mark] if mark else b"")
            elif self._is_word(core, word):
                spelled = word.encode("utf-8").decode("latin-1").translate(self.letters)
                return self._merged(self.lead + spelled if lead else spelled) + (self.first[mark] if mark else b"")
        return self._whole(lead + piece)

    def ids(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if self.blanks == "drop":
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        if _single_blanks(text):
            return self.first["\n"].join([self._joined(line.split(" ")) for line in text.split("\n")])
        return self._joined([p[1:] if i else p for i, p in enumerate(_ALONE.split(text))])

    def _joined(self, parts: list[str]) -> bytes:
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


_ENCODERS: dict = {}


def encoder(path: str, blanks: str, lower: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (path, blanks, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
