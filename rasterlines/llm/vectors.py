"""Words of many texts at once: byte spans and 64-bit hashes by numpy.

A word is a maximal run of bytes of a class; the classes used here put every
byte of a multi-byte UTF-8 character on the same side, so byte spans are
character spans.  Hashes are polynomial over randomised bytes modulo 2**64,
then mixed.  Memory follows the block size, not the length of a text.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=_U)
_powers: dict[str, np.ndarray] = {}

#: Bytes of words between white space (space, tab to carriage return).
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[0x20, *range(9, 14)]] = False
#: Bytes of digits, ASCII letters and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, _U)
        have[0] = 1
        done = 1
        while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
            take = min(done, size - done)
            have[done : done + take] = have[:take] * _U(pow(base, done, 1 << 64))
            done += take
        _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of consecutive texts of about ``most`` bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses from one text into the next."""
    inside = table[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside
    following = ends[1:].copy()
    ends = ends.copy()
    ends[:-1] &= ~following
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.empty(hi - lo + 1, _U)
        sums[0] = 0
        np.cumsum(_BYTE[raw[lo:hi]] * _power(_BASE, hi - lo, "up"), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _power(_INVERSE, hi - lo, "down")[s]
        i = j
    return mix(out)


def counts_in(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text: offsets into them, one more than texts."""
    return np.searchsorted(positions, offsets)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; shorter input gives none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for k in range(size):
        out = out * _U(_BASE) + words[k : k + n]
    return mix(out)


def grams(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words within each text: their hashes, and offsets by text.

    ``bounds`` are the texts' offsets into ``words``.
    """
    every = gram_hashes(words, size)
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    return every[where], at


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept in this Python worker until another key is asked for: a worker serves many stages, and holds one stage's tables."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives up the tables held, so that they don't add up over the stages."""
    _held.clear()
    trim()


def trim() -> None:
    """Gives back what Arrow and the C library keep of memory no longer used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class HashIndex:
    """Numbers 64-bit hashes 0, 1, ... in the order they are added: open addressing over numpy arrays."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << (2 * self.capacity - 1).bit_length()
        self._keys = np.zeros(self.slots, _U)
        self._entry = np.zeros(self.slots, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it isn't held."""
        h = np.where(h == 0, _U(1), h)
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), (h & _U(self.slots - 1)).astype(np.int64)
        while len(todo):
            key = self._keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self._entry[slot[hit]]
            go = ~hit & (key != 0)
            todo, slot = todo[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """``h``: distinct hashes that aren't held; the caller keeps their number within ``room``."""
        h = np.where(h == 0, _U(1), h)
        entry, slot = np.arange(self.n, self.n + len(h), dtype=np.int32), (h & _U(self.slots - 1)).astype(np.int64)
        self.n += len(h)
        while len(h):  # of several that want a free slot the last to write gets it
            free = self._keys[slot] == 0
            self._keys[slot[free]] = h[free]
            won = free & (self._keys[slot] == h)
            self._entry[slot[won]] = entry[won]
            h, entry, slot = h[~won], entry[~won], (slot[~won] + 1) & (self.slots - 1)

    def room(self) -> int:
        return self.slots * 3 // 4 - self.n


def numbered(index: HashIndex, h: np.ndarray, make, forget) -> np.ndarray:
    """Numbers of ``h`` in ``index``; ``make(first positions)`` is called for those that are new.

    When the index holds more than its capacity it is emptied first, and
    ``forget()`` is called; a larger block of distinct hashes enlarges it.
    """
    if index.n > index.capacity:
        index.clear()
        forget()
    entry = index.find(h)
    missing = np.flatnonzero(entry < 0)
    if not len(missing):
        return entry
    new, first = np.unique(h[missing], return_index=True)
    at = missing[first]
    if len(new) > index.room():
        new, at = np.unique(h, return_index=True)
        while index.slots * 3 // 4 < len(new):
            index.capacity *= 2
            index.clear()
        index.clear()
        forget()
    index.add(new)
    make(at)
    return index.find(h)
