"""Words of many texts at once: their places and 64-bit hashes, by array operations over the bytes of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)

_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The lowest n bytes of a number.
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], "u8")

#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 512


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


class Words:
    """The words (runs of characters other than ASCII white space, A-Z lower-cased) of a column of strings; null is empty.

    data: the column's bytes, lower-cased; rows: where texts begin, and the end of the last; start and end: the words' places in data; first: the number of
    words before each row, and of all; hash: of the words, equal ones alike.
    """

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        offsets = np.frombuffer(column.buffers()[1], "i8" if wide else "i4")[column.offset : column.offset + len(column) + 1].astype("i8") if len(column) else np.zeros(1, "i8")
        raw = column.buffers()[2] if len(column) else None
        size = int(offsets[-1] - offsets[0])
        data = np.zeros(size + 8, "u1")  # the padding lets eight bytes be read at any place
        if size:
            data[:size] = _LOWER[np.frombuffer(raw, "u1", size, int(offsets[0]))]
        self.data, self.rows = data, offsets - offsets[0]
        word = np.zeros(size + 2, bool)
        word[1:-1] = ~_SPACE[data[:size]]
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        edges = self.rows[(self.rows > 0) & (self.rows < size)]  # texts stand next to each other
        begins[edges] = word[1:-1][edges]
        ends[edges - 1] = word[1:-1][edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.hash = self._hash()

    @classmethod
    def of(cls, text: str | None) -> Words:
        return cls(pa.array([text], pa.string() if len(text or "") < 1 << 29 else pa.large_string()))

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray((max(0, len(self.data) - 7),), "<u8", self.data, strides=(1,))
        h = mix((eight[self.start] & _MASKS[np.minimum(size, 8)]) ^ (size.astype("u8") * _M2))
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < LONG_WORD:
            h[more] = mix(h[more] + (eight[self.start[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
        for k in more:
            h[k] = xxhash.xxh64_intdigest(self.data[self.start[k] : self.end[k]].tobytes())
        return h

    def sequence(self, row: int) -> np.ndarray:
        """Hashes of the words of a row."""
        return self.hash[self.first[row] : self.first[row + 1]]

    def points(self) -> np.ndarray:
        """The number of code points before each byte, and of all."""
        out = np.zeros(len(self.data) - 7, "i8")
        np.cumsum((self.data[:-8] & 0xC0) != 0x80, out=out[1:])
        return out

    def lines(self, least: int) -> Lines:
        """The lines of at least so many words."""
        breaks = np.flatnonzero(self.data[:-8] == 10)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.first))
        line = np.searchsorted(breaks, self.start)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        lo = np.flatnonzero(new)
        n = np.diff(np.append(lo, len(line)))
        lo, n = lo[n >= least], n[n >= least]
        row, line = row[lo], line[lo]
        begin = np.maximum(self.rows[row], np.append(-1, breaks)[line] + 1)
        end = np.minimum(self.rows[row + 1], np.append(breaks, len(self.data))[line])
        return Lines(self, row, begin, end, lo, n)


class Lines:
    """Lines of a Words: their row, places of begin and end, first word and number of words; key stands for the words of a line."""

    def __init__(self, words: Words, row: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.row, self.begin, self.end, self.n = row, begin, end, n
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.flat = words.hash[np.repeat(first, n) + nth]  # hashes of the lines' words, laid end to end
        placed = mix(self.flat + (nth.astype("u8") + np.uint64(1)) * _M2)
        sums = np.add.reduceat(placed, np.cumsum(n) - n) if len(n) else np.zeros(0, "u8")
        self.key = mix(sums + n.astype("u8")).view("i8")
