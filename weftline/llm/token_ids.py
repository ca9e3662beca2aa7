"""Token ids of whole texts by the tokenizers library, with ids of recurring pieces kept.

Both vocabularies split a text before byte-pair merging, and the split never crosses certain
places. The text is therefore cut at such places, every distinct piece is encoded once by the
library, and its ids are kept as little-endian bytes; a document's ids are the joined bytes. The
kept pieces are bounded: when there are ``KEPT`` of them they are dropped and gathered anew. Names of
added tokens in a text get those tokens' ids, as the library does unless told otherwise; no cut falls
inside one.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Pieces kept for each vocabulary and worker.
KEPT = 500_000
#: Letters of this range have kept their class and their composed form in all Unicode versions.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ƺ]+)([!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~-]*)")
#: Where a byte-level text may be cut: between non-spaces, before one blank or around one newline.
_UNSURE = "᠎​﻿"
_CUT = re.compile("(?<=[^\\s᠎​﻿])(?=[ \n][^\\s᠎​﻿])|(?<=[^\\s᠎​﻿]\n)(?=[^\\s᠎​﻿])")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


_LETTER = [c for _, c in sorted(_byte_letters().items())]


def _letters(word: str) -> str:
    """The stand-ins of a word's bytes; ASCII letters and signs stand for themselves."""
    return word if word.isascii() else "".join([_LETTER[b] for b in word.encode()])


class _Careful(Exception):
    """A text has white space at which the quick way may not cut."""


class _Pieces(dict):
    """Little-endian 32-bit ids of pieces; a missing piece is encoded and kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) >= KEPT:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteLevelIds:
    """Ids of a byte-level vocabulary that keeps a blank before a word as part of the word.

    Pieces are words without their blank; a word that follows a newline carries the newline,
    and a text's first word carries a zero character.
    """

    def __init__(self, path: str):
        self.tok = _load(path)
        self.pieces, self.tails = _Pieces(self._make), _Pieces(self._merged)
        self.tails[""] = b""
        self.newline = self._library("\n")

    def _library(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def _merged(self, pre: str) -> bytes:
        return _packed([t.id for t in self.tok.model.tokenize(pre)])

    def _make(self, piece: str) -> bytes:
        lead = piece[:1]
        before, blank, word = (self.newline, "", piece[1:]) if lead == "\n" else (b"", "", piece[1:]) if lead == "\0" else (b"", " ", piece)
        if m := _PLAIN.fullmatch(word):
            stem, tail = m.groups()
            known = self.pieces.get(stem) if blank and tail else None
            return before + (known or self._merged((_LETTER[32] if blank else "") + _letters(stem))) + self.tails[tail]
        if not word or not word.isprintable() or word[0] in _UNSURE or word[-1] in _UNSURE:
            raise _Careful
        return before + self._library(blank + word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" in text:  # it would pass for the mark of a first word
            return self._slow(text)
        try:
            return b"".join(map(self.pieces.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))
        except _Careful:
            return self._slow(text)

    def _slow(self, text: str) -> bytes:
        out = []
        for p in _CUT.split(text):
            try:
                if p[0] == " ":
                    out.append(self.pieces[p[1:]] if p[1:2] not in ("\n", "\0") else self._library(p))
                else:
                    out.append(self.pieces[p] if p[0] == "\n" else self._library(p))
            except _Careful:
                out.append(self._library(p))
        return b"".join(out)


class WordIds:
    """Ids of a vocabulary that lower-cases and drops white space, so any blank is a place to cut."""

    def __init__(self, path: str):
        self.tok = _load(path)
        self.words, self.tails = _Pieces(self._word), _Pieces(self._merged)

    def _merged(self, pre: str) -> bytes:
        return _packed([t.id for t in self.tok.model.tokenize(pre)]) if pre else b""

    def _word(self, piece: str) -> bytes:
        if not piece:
            return b""
        if m := _PLAIN.fullmatch(piece):
            stem, tail = m.groups()
            return (tail and self.words.get(stem) or self._merged(_letters(stem.lower()))) + self.tails[tail]
        return _packed(self.tok.encode(piece, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def _packed(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_loaded: dict[tuple[str, str], object] = {}


def encoder(kind: str, path: str):
    """The encoder of this worker for a vocabulary file; kind: byte_level or words."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = {"byte_level": ByteLevelIds, "words": WordIds}[kind](path)
    return _loaded[kind, path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
