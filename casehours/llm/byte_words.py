"""Words of a byte stream and a bounded table of their token ids, in numpy.

A stream has UTF-8 texts with a NUL after each. Words are found for texts of usual characters, about whose class every
Unicode version agrees; other texts are the caller's. The table knows words of up to 16 bytes by two 64-bit integers
that hold the bytes themselves, so that equal keys are equal words; longer words are kept in a dictionary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from casehours.llm.shingles import mix

LETTER, DIGIT, SPACE, BLANK, OTHER, END, ODD = range(7)


def _kind(char: str) -> int:
    if char == " ":
        return SPACE
    if char in "\t\n\r":
        return BLANK
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(char)[0], OTHER)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte that decides by itself, and of the characters U+00A0 to U+00BF by their second byte."""
    table = np.full(256, ODD, np.uint8)
    table[0] = END
    for code in (9, 10, 13, *range(32, 127)):
        table[code] = _kind(chr(code))
    table[0x80:0xC0] = LETTER  # later bytes of U+00C0 to U+017F, which are letters but for two
    table[0xC3:0xC6] = LETTER
    second = np.full(256, ODD, np.uint8)
    for code in range(0xA1, 0xC0):
        second[code] = _kind(chr(code))
    return table, second


_KINDS, _SECOND = _kinds()
_TIMES = (0x97, 0xB7)  # second bytes of the multiplication and division signs
_CONTRACTED = {c: n for n, words in ((2, "stmd"), (3, ("re", "ve", "ll"))) for c in words}
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def kinds_of(data: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte belongs to; ``ODD`` where a character is not usual."""
    kind = _KINDS[data]
    at = np.flatnonzero(data == 0xC2)
    kind[at] = kind[at + 1] = _SECOND[data[at + 1]]
    at = np.flatnonzero(data == 0xC3)
    at = at[np.isin(data[at + 1], _TIMES)]
    kind[at] = kind[at + 1] = OTHER
    at = np.flatnonzero(data == 0xE2)  # dashes, quotation marks and the like, U+2010 to U+2027
    at = at[(data[at + 1] == 0x80) & (data[at + 2] >= 0x90) & (data[at + 2] <= 0xA7)]
    kind[at] = kind[at + 1] = kind[at + 2] = OTHER
    return kind


def word_starts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First byte of every word of a stream of usual texts; a text's NUL is a word by itself.

    A word is a contraction, or a run of one kind with a space before it, or white space that no word takes.
    """
    before = np.concatenate([[END], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [END]]).astype(np.uint8)
    white = (kind == SPACE) | (kind == BLANK)
    white_before = (before == SPACE) | (before == BLANK)
    white_after = (after == SPACE) | (after == BLANK)
    start = np.where(white, ~white_before | ~(white_after | (after == END)), (kind != before) & (before != SPACE))
    start[kind == END] = True
    for i in np.flatnonzero(data == 39):
        if before[i] in (OTHER, SPACE):
            continue
        tail = data[i + 1 : i + 3].tobytes().decode("latin-1")
        n = _CONTRACTED.get(tail[:1]) or _CONTRACTED.get(tail)
        if n:
            start[i + 1 : i + n] = False
            start[i + n : i + n + 1] = True
    return np.flatnonzero(start)


def windows(data: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Pieces of a stream of ``window`` bytes or so, cut where a word starts whatever surrounds it: a space between letters, or after a NUL."""
    a = 0
    letter = _KINDS == LETTER
    while a < len(data):
        b = a + window
        while b < len(data):
            x = data[b - window : b + 2]
            cuts = np.flatnonzero((x[1:-1] == 32) & letter[x[:-2]] & letter[x[2:]] | (x[:-2] == 0)) + 1
            if len(cuts) and b - window + cuts[-1] > a:
                b = b - window + int(cuts[-1])
                break
            b += window
        b = min(b, len(data))
        yield a, b
        a = b


class WordTable:
    """Token ids of words, found for whole arrays of words at once; holds ``capacity`` words, and those of one stream beyond.

    ``encode`` gives the ids of words, one after another, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], capacity: int):
        self.encode, self.capacity = encode, capacity
        self._clear()

    def _clear(self) -> None:
        self.bits = 12
        self.value = np.full(1 << 12, -1, np.int32)
        self.n, self.n_ids = 0, 0
        self.first, self.ids, self.used = np.zeros(1025, np.int64), np.zeros(4096, np.uint32), np.zeros(1024, bool)
        self.keys = np.zeros((1024, 2), np.uint64)
        self.long: dict[bytes, int] = {}

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + np.uint64(1))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys, -1 for unknown ones."""
        slot, left = self._home(low, high), np.arange(len(low))
        found = np.empty(len(low), np.int32)
        while len(left):
            value = self.value[slot]
            found[left] = value
            other = np.flatnonzero((value >= 0) & ((self.keys[value, 0] != low[left]) | (self.keys[value, 1] != high[left])))
            left, slot = left[other], (slot[other] + 1) & ((1 << self.bits) - 1)
        return found

    def _place(self, value: np.ndarray) -> None:
        """Put the keys of new values, which are distinct, into free slots."""
        slot, left = self._home(self.keys[value, 0], self.keys[value, 1]), value
        while len(left):
            free = self.value[slot] < 0
            self.value[slot[free]] = left[free]  # of several keys for one slot the last stays
            lost = self.value[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Values of new words: their token ids one after another, and how many each has."""
        n, n_ids = self.n + len(lengths), self.n_ids + len(ids)
        while n > len(self.used):
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])
            self.first = np.concatenate([self.first, np.zeros(len(self.used) // 2, np.int64)])
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        if n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), n_ids - len(self.ids)), np.uint32)])
        self.ids[self.n_ids : n_ids] = ids
        self.first[self.n + 1 : n + 1] = self.n_ids + np.cumsum(lengths)
        values = np.arange(self.n, n, dtype=np.int32)
        self.n, self.n_ids = n, n_ids
        return values

    def _put(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        values = self._append(ids, lengths)
        self.keys[values, 0], self.keys[values, 1] = low, high
        if self.n * 2 > 1 << self.bits:
            self.bits = int(self.n * 3).bit_length()
            self.value = np.full(1 << self.bits, -1, np.int32)
            short = np.setdiff1d(np.arange(self.n, dtype=np.int32), np.fromiter(self.long.values(), np.int32, len(self.long)))
            self._place(short)
        else:
            self._place(values)
        return values

    def _make_room(self) -> None:
        """When the table is full: words that came up since the last time stay, unless they fill half of it themselves."""
        if self.n < self.capacity:
            return
        kept = np.flatnonzero(self.used[: self.n])
        kept = kept if 2 * len(kept) < self.capacity else kept[:0]
        is_long = np.isin(kept, np.fromiter(self.long.values(), np.int64, len(self.long)))
        words = {v: w for w, v in self.long.items()}
        long = [words[v] for v in kept[is_long].tolist()]
        keys, short_ids, long_ids = self.keys[kept[~is_long]], self.ids_of(kept[~is_long]), self.ids_of(kept[is_long])
        self._clear()
        self._put(keys[:, 0], keys[:, 1], *short_ids)
        self.long = dict(zip(long, self._append(*long_ids).tolist(), strict=True))

    def values(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Value of each word of a stream; new words are encoded and learned."""
        self._make_room()
        lengths = np.diff(np.append(starts, len(data)))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        low = eights[starts] & _MASKS[np.minimum(lengths, 8)]
        high = eights[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 8)]
        is_long = lengths > 16
        found = self._find(low, high)
        missing = np.flatnonzero((found < 0) & ~is_long)
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            new = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
            first = order[new]
            raw = data.tobytes()
            words = [raw[a : a + n] for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
            values = self._put(low[first], high[first], *self.encode(words))
            found[order] = values[np.cumsum(new) - 1]
        if is_long.any():
            at = np.flatnonzero(is_long)
            words = [data[a : a + n].tobytes() for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            if fresh := [w for w in dict.fromkeys(words) if w not in self.long]:
                self.long.update(zip(fresh, self._append(*self.encode(fresh)).tolist(), strict=True))
            found[at] = [self.long[w] for w in words]
        self.used[found] = True
        return found

    def ids_of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words one after another, and how many each has."""
        return gathered(self.ids, self.first, values)


def gathered(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``ids[first[k] : first[k + 1]]`` for every k of ``at`` one after another, and their lengths."""
    counts = first[at + 1] - first[at]
    ends = np.cumsum(counts)
    return ids[np.repeat(first[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts
