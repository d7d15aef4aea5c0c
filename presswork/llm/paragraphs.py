"""Content-defined paragraphs: cuts of a text's word stream that depend on the words near them only.

A word is what stands between white space (\x20, \x09-\x0D), with A-Z lower-cased. Each
place has the hash of its word and the next one; a place is a cut if its hash is the
least of the `REACH` places before and after it. So a passage has the same cuts
wherever it stands, whatever the lines, but for those that see its surroundings.
What lies between two cuts is a fine paragraph (13 words on average, more than
`REACH` but at the only one of a short text). A quarter of the cuts, chosen by their
hash, also bound coarse paragraphs. A text's first and last `REACH` words are not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .ngram_join import SHINGLE, Hasher, mix

REACH = 6
#: One fine cut in so many is a coarse one, by the low bits of its hash.
COARSE = 4
_U = np.uint64


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row."""
    out, size = values, 1
    while 2 * size <= width:
        out, size = np.minimum(out[: len(out) - size], out[size:]), 2 * size
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that follow each other in `data`, of `sizes` items each."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes * data.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class Cuts:
    """The paragraphs of many texts at once. Places are word numbers over all texts."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode() for t in texts]
        self.raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
        self.codes, self.starts, self.ends = Hasher.one().words(self.raw, 1)
        n = len(self.codes)
        #: place of the first byte of each text, and its first word; the last ones are those of the end
        self.byte_at = np.cumsum([1, *(len(d) + 1 for d in data)])
        self.word_at = np.searchsorted(self.starts, self.byte_at)
        size = np.diff(self.word_at)
        owner = np.repeat(np.arange(len(data)), size)
        seeds = self.codes.copy()
        seeds[: n - 1] += self.codes[1:] * _U(0x9E3779B97F4A7C15)
        last = self.word_at[1:][size > 0] - 1
        seeds[last] = self.codes[last]  # the last word of a text has none behind it
        seeds = mix(seeds)
        spread = np.full(n + REACH * (len(data) + 1), ~_U(0))
        at = np.arange(n) + REACH * (owner + 1)
        spread[at] = seeds
        low = least_of(spread, REACH)
        cut = (seeds < low[at - REACH]) & (seeds <= low[at + 1])
        into, left = np.arange(n) - self.word_at[owner], self.word_at[owner + 1] - np.arange(n)
        cut &= (into > REACH) & (left > REACH)
        strong = cut & (seeds % _U(COARSE) == 0)
        first = self.word_at[:-1][size > 0]
        cut[first] = strong[first] = True
        self.fine, self.coarse = (self._bounds(c) for c in (cut, strong))
        self.owner = owner

    def _bounds(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(cut)
        return begin, np.append(begin[1:], len(cut))[: len(begin)]

    def hashes(self, bounds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the words of each paragraph."""
        out, size = [], (bounds[1] - bounds[0]).astype(_U)
        for up, down in Hasher.one().powers:
            total = np.zeros(len(self.codes) + 1, _U)
            np.cumsum(self.codes * up[: len(self.codes)], out=total[1:])
            out.append(mix(mix((total[bounds[1]] - total[bounds[0]]) * down[bounds[0]]) + size))
        return out[0], out[1]

    def shingles(self) -> np.ndarray:
        """The hash of the five words from each place on; those that leave a paragraph are not to be used."""
        up, down = Hasher.one().powers[0]
        total = np.zeros(len(self.codes) + SHINGLE, _U)
        np.cumsum(self.codes * up[: len(self.codes)], out=total[1 : len(self.codes) + 1])
        total[len(self.codes) + 1 :] = total[len(self.codes)]
        return mix((total[SHINGLE:] - total[: len(self.codes)]) * down[: len(self.codes)])

    def chars(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])


class Recent:
    """Remembers many of the numbers seen, in a table of fixed size: a number told as new may have been seen."""

    def __init__(self, bits: int = 20):
        self.slots, self.shift = np.zeros(1 << bits, _U), _U(64 - bits)

    def told(self, numbers: np.ndarray) -> np.ndarray:
        """Which numbers are remembered."""
        return self.slots[numbers >> self.shift] == numbers

    def new(self, numbers: np.ndarray) -> np.ndarray:
        """Places of distinct numbers that are not remembered."""
        each, at = np.unique(numbers, return_index=True)
        slot = each >> self.shift
        fresh = self.slots[slot] != each
        self.slots[slot] = each
        return np.sort(at[fresh])
