"""Tokens of texts, piece by piece, with a bounded memory of pieces seen before.

A single space between two characters that aren't white space is a place where
text may be cut: none of the tokenizers used here joins anything across it.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

#: Pieces that a worker remembers: the first that it meets.
REMEMBER = 400_000
#: Longer pieces are not remembered.
LONGEST = 64

_BETWEEN = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_RUNS = re.compile(r"[\s▁] | [\s▁]")
#: A line break between two characters that aren't white space is a pre-token by itself.
_LINE = re.compile(r"(?<=\S)(\n)(?=\S)")
#: Letters are one pre-token, and marks after them another.
_MARKED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def per_worker(key: object, make: Callable):
    """What ``make`` gives, made once in a Python worker and kept between its tasks."""
    name = "tidemill_worker_state"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Memo(dict):
    """What ``make`` gives for a piece, remembered while there is room."""

    def __init__(self, make: Callable[[str], object], limit: int = REMEMBER):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str):
        made = self.make(piece)
        if len(self) < self.limit and len(piece) <= LONGEST:
            self[piece] = made
        return made


class ByteLevel:
    """Byte-level BPE of whole texts, word by word.

    ``encode`` does any piece of text, ``encode_word`` a piece that is one pre-token of
    letters; ``join`` puts what they give together.
    """

    def __init__(self, encode: Callable, join: Callable, encode_word: Callable | None = None):
        self.encode, self.join, self.encode_word = encode, join, encode_word or encode
        self.plain = Memo(self._made)
        #: Pieces that come after a space, without it.
        self.spaced = Memo(lambda piece: self._made(" " + piece))

    def _made(self, piece: str):
        marked = _MARKED.fullmatch(piece)
        if marked:
            word, marks = marked.groups()
            if marks:
                return self.join([self._known(word), self.plain[marks]])
            return self.encode_word(word)
        parts = _LINE.split(piece) if "\n" in piece else [piece]
        if len(parts) > 1:
            return self.join([self._known(part) for part in parts])
        return self.encode(piece)

    def _known(self, piece: str):
        return self.spaced[piece[1:]] if piece[:1] == " " else self.plain[piece]

    def parts(self, text: str) -> list:
        """What the words of ``text``, which isn't empty, give in turn."""
        first, *rest = words(text)
        return [self.plain[first], *map(self.spaced.__getitem__, rest)]


def words(text: str) -> list[str]:
    """Parts of ``text`` that joined by single spaces give ``text``."""
    if _RUNS.search(text) or text[:1] == " " or text[-1:] == " ":
        return _BETWEEN.split(text)
    return text.split(" ")
