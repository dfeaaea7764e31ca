"""Texts to token ids by way of their distinct pieces.

Byte-level BPE never merges across the pieces that its pattern cuts a text into, so every
distinct piece is encoded once and a text's ids are gathered from the results. Memory is
bounded: the cache starts anew beyond ``MOST`` pieces, and texts go through in portions; a
longer text is cut where white space follows something else, which is always between pieces.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

MOST = 250_000
PORTION = 1_000_000  # characters

# The pattern that ``split`` follows, and Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, LETTER, NUMBER, OTHER = range(4)
_BETWEEN = re.compile(r"\S(?=[ \n\t\r])")


def character_kinds() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    major = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
    kinds[[i for i, c in enumerate(major) if c == "L"]] = LETTER
    kinds[[i for i, c in enumerate(major) if c == "N"]] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def portions(texts: list[str], most: int = PORTION) -> Iterator[list[str]]:
    """Consecutive texts of together about ``most`` characters, at least one."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def cuts(text: str, most: int = PORTION) -> list[str]:
    """The text in parts of about ``most`` characters, cut only between pieces."""
    parts, at = [], 0
    while len(text) - at > most and (m := _BETWEEN.search(text, at + most)):
        parts.append(text[at:m.end()])
        at = m.end()
    return [*parts, text[at:]]


def split(joined: str, code: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN start; ``first`` has where texts start, and the end."""
    n = len(code)
    kind = kinds[code]
    starts = np.ones(n + 1, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    starts |= text_start
    run = np.flatnonzero(starts[:n])
    end = np.append(run[1:], n)
    kind = kind[run]
    goes_on = ~text_start[end]
    # White space before something else: its last character is apart, a blank joins what follows.
    last = end[(kind == SPACE) & goes_on]
    starts[last - 1] = True
    starts[last[code[last - 1] == 32]] = False
    # An apostrophe that starts a piece may take one or two of the letters after it.
    quote = np.flatnonzero((kind == OTHER) & (end - run == 1) & goes_on)
    quote = quote[(code[run[quote]] == 39) & starts[run[quote]] & (kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER)]
    for q in quote.tolist():
        a = int(end[q])
        word = joined[a:min(a + 2, int(end[q + 1]))]
        taken = 1 if word[:1] in ("s", "t", "m", "d") else 2 if word in ("re", "ve", "ll") else 0
        if taken:
            starts[a], starts[a + taken] = False, True
    return np.flatnonzero(starts[:n])


def spans(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[first[0]:first[0] + length[0]], and so on, end to end."""
    before = np.cumsum(length) - length
    return values[np.repeat(first - before, length) + np.arange(int(length.sum()))]


def alike(code: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A class for each piece, the same for equal pieces.

    Pieces are classed by a polynomial hash, taken from prefix sums, and their length. Each is
    then compared with its class's first piece; if any differed, all would be told apart by
    their text.
    """
    n = len(code)
    power = np.cumprod(np.full(n, _BASE), dtype=np.uint64)
    back = np.cumprod(np.full(n, _BACK), dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(code * power, dtype=np.uint64))
    key = (total[start + length] - total[start]) * back[start] if n else np.zeros(0, np.uint64)
    key = (key ^ (key >> np.uint64(29))) * _BASE + length.astype(np.uint64)
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    twin = first[same]
    if np.array_equal(length, length[twin]) and np.array_equal(code, spans(code, start[twin], length)):
        return same
    text = [code[a:a + k].tobytes() for a, k in zip(start.tolist(), length.tolist())]
    return np.unique(np.array(text, object), return_inverse=True)[1]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Pieces:
    """``encode_new`` takes distinct pieces and returns (ids end to end, ids of each)."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.kinds = character_kinds()
        self.encode_new = encode_new
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _entries(self, pieces: list[str]) -> np.ndarray:
        """The entry of each of these distinct pieces."""
        at = [*map(self.known.get, pieces)]
        new = [p for p, i in zip(pieces, at) if i is None]
        if new:
            if len(self.known) + len(new) > MOST:
                self._reset()
                new = pieces
            ids, length = self.encode_new(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.first = np.append(self.first, len(self.ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.ids = np.append(self.ids, ids)
            at = [*map(self.known.__getitem__, pieces)]
        return np.array(at, np.int64)

    def _encode(self, joined: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids end."""
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = split(joined, code, first, self.kinds)
        length = np.diff(np.append(start, len(code)))
        same = alike(code, start, length)
        one = np.zeros(int(same.max(initial=-1)) + 1, np.int64)
        one[same] = np.arange(len(same))  # some piece of each class
        a, b = start[one].tolist(), (start[one] + length[one]).tolist()
        entry = self._entries([joined[i:j] for i, j in zip(a, b)])[same]
        n = self.length[entry]
        ends = np.append(0, np.cumsum(n))[np.searchsorted(start, first[1:])]
        return spans(self.ids, self.first[entry], n), ends

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for part in portions(texts):
            parts = cuts(part[0])
            if len(parts) > 1:  # stands alone
                yield np.concatenate([self._encode(c, np.array([0, len(c)]))[0] for c in parts])
                continue
            ids, ends = self._encode("".join(part), np.cumsum([0, *map(len, part)]))
            yield from np.split(ids, ends[:-1])
