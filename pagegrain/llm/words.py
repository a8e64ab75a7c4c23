"""Words of Arrow text columns as numpy arrays.

Texts are handled as the UTF-8 bytes Arrow already holds: word bounds, word codes and hashes
of word windows are all computed for many documents at once, without a Python object per word.

A word's code is 128 bits: up to 15 bytes, the bytes themselves and their number, so that equal codes
mean equal words; beyond, 120 bits of BLAKE2b. Hashes of several words are built by doubling: a
window of 2n words from its two halves, by a mixer that isn't linear, in two lanes of 64 bits
with constants of their own. Both lanes start from the whole code.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
SHORT = 15  # the longest word that is its own code

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.ones(256, bool)  # bytes that end a run of letters and digits; all beyond ASCII count as letters
NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

# For each lane, odd factors for the left and right part and for the length.
_LEFT = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_RIGHT = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_SIZE = (_U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of a followed by b, both hashes."""
    return mix(a * _LEFT[lane] + b * _RIGHT[lane] + _SIZE[lane])


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte spans [start, end): low and high 64 bits. The high one is never 0, unless the span is empty."""
    size = ends - starts
    padded = np.zeros(data.size + 16, np.uint8)
    padded[: data.size] = data
    eight = np.ndarray((data.size + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    low = eight[starts] & _MASK[np.minimum(size, 8)]
    high = (eight[starts + 8] & _MASK[np.clip(size - 8, 0, 7)]) | (np.minimum(size, SHORT).astype(_U) << _U(56))
    far = np.flatnonzero(size > SHORT)
    if far.size:
        raw = memoryview(np.ascontiguousarray(data))
        made = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True))
        made = np.frombuffer(made, "<u8").reshape(-1, 2)
        low[far], high[far] = made[:, 0], made[:, 1] | _U(0xFF << 56)
    return low, high


class Texts:
    """Some documents' words. ``first[i]:first[i + 1]`` are the words of document i.

    ``space`` marks the bytes that end a word. With ``alone``, each character of a script that puts no spaces
    between words is a word of its own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE, alone: bool = False) -> None:
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        self.n = offsets.size - 1
        inside = ~space[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        if data.size:
            firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
            begin[firsts] = inside[firsts]
            lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            end[lasts] = inside[lasts]
        if alone:
            at, size = unspaced(data)
            begin[at] = True
            end[at + size - 1] = True
            end[at[at > 0] - 1] |= inside[at[at > 0] - 1]
            behind = (at + size)[at + size < data.size]
            begin[behind] |= inside[behind]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self._codes: tuple[np.ndarray, np.ndarray] | None = None
        self._lanes: dict[int, np.ndarray] = {}

    @property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._codes is None:
            self._codes = span_codes(self.data, self.starts, self.ends)
        return self._codes

    def lane(self, which: int = 0) -> np.ndarray:
        """Hashes of the words."""
        if which not in self._lanes:
            low, high = self.codes
            self._lanes[which] = joined(mix(low + _SIZE[which]), mix(high + _LEFT[which]), which)
        return self._lanes[which]

    @property
    def hash(self) -> np.ndarray:
        return self.lane(0)

    def numbers(self) -> np.ndarray:
        """A number for each word, from 0: equal for equal codes alone."""
        low, high = self.codes
        order = np.argsort(self.hash, kind="stable")
        a, b, h = low[order], high[order], self.hash[order]
        new = np.ones(h.size, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if (new[1:] & (h[1:] == h[:-1])).any():  # different words of one hash may take turns
            order = np.lexsort((low, high))
            a, b = low[order], high[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.empty(h.size, np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows by start word (over all documents) and whether each stays in one document."""
        m = self.starts.size - k + 1
        if m <= 0:
            return np.zeros(0, _U), np.zeros(0, bool)
        h, span = self.lane(which), 1
        while 2 * span <= k:
            h, span = joined(h[:-span], h[span:], which), 2 * span
        if span < k:
            h = joined(h[:m], h[k - span :], which)
        return h, self.doc[:m] == self.doc[k - 1 :]

    def ranges(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of word ranges of any lengths from 1 on; ``which`` picks the lane."""
        size = ends - starts
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(size.size, _U)
        h, span = self.lane(which), 1
        for k in range(int(level.max()) + 1 if level.size else 0):
            if k:
                h, span = joined(h[:-span], h[span:], which), 2 * span
            own = np.flatnonzero(level == k)
            out[own] = mix(joined(h[starts[own]], h[ends[own] - span], which) + size[own].astype(_U) * _SIZE[which])
        return out

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of characters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, bopomofo and Han."""
    padded = np.append(data, [0, 0]).astype(np.uint8)
    a, b = padded[:-2], padded[1:-1]
    three = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F)))
    three |= ((a == 0xE3) & (b >= 0x81)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
    four = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    at = np.flatnonzero(three | four)
    return at, np.where(four[at], 4, 3)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and row offsets. Null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with whole rows and about ``size`` bytes of text at most (one row may be longer)."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's words."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions some range [start, end) covers."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
