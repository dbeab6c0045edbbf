"""Texts cut into words that a tokenizer encodes independently of each other.

Byte-level BPE splits a text by a pattern before it merges, and no match of that
pattern has white space after any other character. A vocabulary of pieces in
which the space mark stands only at the start has the same property. So the
place before a space that follows a character which is no white space is always
a token boundary, for either kind, and the parts can be encoded by themselves.
Words repeat, so a worker remembers what it made of those it met last.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np

_SPACE_AFTER_SPACE = re.compile(r"\s ").search
_CUT = re.compile(r"(?<=\S) ").split
#: What a worker remembers in each of two generations: characters of words, and 40 for each word.
REMEMBERED = 10_000_000


def cut(text: str) -> list[str]:
    """The parts of ``text``; the space before each part but the first is left out."""
    return _CUT(text) if _SPACE_AFTER_SPACE(text) else text.split(" ")


class Remembered:
    """``make(list of words)`` word by word. Of two generations the older goes when the
    newer is full; this changes speed, not results."""

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int = REMEMBERED):
        self.make, self.limit, self.size, self.new, self.old = make, limit, 0, {}, {}

    def of(self, words: set[str]) -> dict:
        """A mapping that holds all of ``words``."""
        missing = words - self.new.keys()
        if missing and self.size > self.limit:
            self.old, self.new, self.size, missing = self.new, {}, 0, words
        known = {w: v for w in missing if (v := self.old.get(w)) is not None}
        rest = [w for w in missing if w not in known]
        self.new |= known
        self.new.update(zip(rest, self.make(rest), strict=True))
        self.size += sum(map(len, missing)) + 40 * len(missing)
        return self.new


def tokenizer(definition: str, plain: bool = False):
    """The library's tokenizer from its JSON text; with ``plain``, the strings of special
    tokens inside a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer
    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = plain
    return made


def packed(made, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    return [np.array(e.ids, dtype="<u4").tobytes() for e in made.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder:
    """The library's ids of whole texts, word by word."""

    def __init__(self, definition: str, plain: bool = False, limit: int = REMEMBERED):
        made = tokenizer(definition, plain)
        self.first = Remembered(lambda words: packed(made, words), limit // 4)
        self.later = Remembered(lambda words: packed(made, [" " + w for w in words]), limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [cut(t) for t in texts]
        first = self.first.of({p[0] for p in parts})
        later = self.later.of({w for p in parts for w in p[1:]})
        return [b"".join([first[p[0]], *map(later.__getitem__, p[1:])]) for p in parts]
