"""Token ids of whole texts with a public tokenizer, many texts at a time.

Byte-pair encoders of the pre-splitting kind never merge across a word
boundary, so a text's ids are those of its words in a row.  Texts are cut
before white space that follows a printable ASCII character or a letter, and
before ``. , ! ? ; :`` after an ASCII letter; every such place is a boundary of
the tokenizer's own splitting.  Each distinct piece is encoded once by the
tokenizers library and remembered in a table of bounded size; the ids of all
pieces are then gathered by numpy.  Texts with rarer kinds of white space are
encoded in one call, uncut.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import vectors

_SPACE = ~vectors.BETWEEN_SPACES
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True
#: White space other than space and tab to carriage return, in UTF-8.
_RARE_SPACE = [bytes([b]) for b in range(0x1C, 0x20)] + [
    chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
]
_LEAD = np.zeros(256, bool)
_LEAD[[x[0] for x in _RARE_SPACE]] = True


#: New pieces given to the tokenizers library at a time.
ADD_PIECES = 4096


class PieceEncoder:
    """Ids of pieces by hash, forgotten when ``capacity`` pieces are held."""

    def __init__(self, path: str, capacity: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.index = vectors.HashIndex(capacity)
        self._clear()

    def _clear(self) -> None:
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.n = self.used = 0

    def _add(self, pieces: list[str]) -> None:
        # The library's encodings take much more room than their ids.
        for i in range(0, len(pieces), ADD_PIECES):
            self._add_few(pieces[i : i + ADD_PIECES])

    def _add_few(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        while self.n + len(ids) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.begin[self.n : self.n + len(ids)] = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.count[self.n : self.n + len(ids)] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text)."""
        n = len(offsets) - 1
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        whole = raw.tobytes()
        if _LEAD[raw].any() and any(x in whole for x in _RARE_SPACE):
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if n == 1:
                return self._plain(texts)
            odd = [any(x in t for x in map(bytes.decode, _RARE_SPACE)) for t in texts]
            parts = [self._plain([t]) if o else self.encode(raw[a:b], np.array([0, b - a])) for t, o, a, b in zip(texts, odd, offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum([p[1][-1] for p in parts])])
        if self.folds and b"<|" not in whole:  # the tokenizer lower-cases anyway
            raw = vectors.LOWER[raw]
            whole = raw.tobytes()
        space = _SPACE[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = space[1:] & ~space[:-1] | _STOP[raw[1:]] & _LETTER[raw[:-1]]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        h = vectors.span_hashes(raw, starts, ends)
        new = lambda at: self._add([whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[at], ends[at], strict=True)])
        entry = vectors.numbered(self.index, h, new, self._clear)
        counts = self.count[entry].astype(np.int64)
        after = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.begin[entry] - after[:-1], counts) + np.arange(after[-1])]
        return ids, after[np.searchsorted(starts, offsets)]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        counts = np.concatenate([[0], np.cumsum([len(e.ids) for e in found])]).astype(np.int64)
        return np.fromiter((x for e in found for x in e.ids), np.int32, int(counts[-1])), counts


def piece_encoder(path: str, capacity: int = 1 << 20) -> PieceEncoder:
    """One per Python worker, for as long as its tasks use this tokenizer."""
    return vectors.held(("tokenizer", path, capacity), lambda: PieceEncoder(path, capacity))


def with_last(ids: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each text."""
    n = len(offsets) - 1
    to = offsets + np.arange(n + 1)
    out = np.full(to[-1], last, np.int32)
    keep = np.ones(to[-1], bool)
    keep[to[1:] - 1] = False
    out[keep] = ids
    return out, to
