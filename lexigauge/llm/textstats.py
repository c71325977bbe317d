"""Per-text counts in numpy: words, repeats, character classes. Plain functions on one text, used inside tasks."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Character classes: lower case and other letters, upper case, digits, spaces, line ends, sentence marks, the rest.
CLASSES = ("lower", "upper", "digit", "space", "line", "mark", "other")
#: Fixed sets: white space that parts words, symbols that count as noise.
BLANK, SYMBOLS, MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", ".,;:!?'\"()-"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, 1 if blank, 1 if symbol."""
    kinds = np.full(0x110000, 6, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kinds[c] = 1 if k == "Lu" else 0
        elif k[0] == "N":
            kinds[c] = 2
    kinds[ord(" ")], kinds[ord("\n")] = 3, 4
    kinds[[ord(c) for c in MARKS]] = 5
    blank, symbol = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    blank[[ord(c) for c in BLANK]], symbol[[ord(c) for c in SYMBOLS]] = True, True
    return kinds, blank, symbol


def class_counts(text: str | None) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(_tables()[0][np.frombuffer((text or "").encode("utf-32-le"), np.uint32)], minlength=len(CLASSES))


class TextStats:
    """Counts of one text; a null text counts as empty."""

    __slots__ = ("classes", "distinct", "ids", "n_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_symbols", "n_words", "word_chars", "words")

    def __init__(self, text: str | None):
        kinds, blank, symbol = _tables()
        text = text or ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.n_chars = len(points)
        self.classes = np.bincount(kinds[points], minlength=len(CLASSES))
        self.n_symbols = int(np.count_nonzero(symbol[points]))
        self.word_chars = self.n_chars - int(np.count_nonzero(blank[points]))
        index: dict[bytes, int] = {}
        self.words = text.encode().split()
        self.ids = np.array([index.setdefault(w, len(index)) for w in self.words], np.int64)
        self.distinct = list(index)
        self.n_words = len(self.words)
        seen: set[str] = set()
        self.n_lines = self.n_dup_lines = 0
        for line in text.split("\n"):
            if line.strip(BLANK):
                self.n_lines += 1
                self.n_dup_lines += line in seen
                seen.add(line)
        self.n_repeat_words = self._repeats(3)

    def _repeats(self, n: int) -> int:
        """Words that lie in a window of ``n`` words found twice or more, its first find included."""
        m = len(self.ids) - n + 1
        if m < 2:
            return 0
        key = self.ids[:m]
        for k in range(1, n):  # the number of a window of k + 1 words among all such windows
            key = np.unique(key * len(self.distinct) + self.ids[k : k + m], return_inverse=True)[1]
        twice = np.bincount(key)[key] > 1
        if not twice.any():
            return 0
        edge = np.zeros(len(self.ids) + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        return int(np.count_nonzero(np.cumsum(edge)))
