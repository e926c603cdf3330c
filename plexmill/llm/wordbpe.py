"""Ids of a word-end BPE vocabulary (JSON of the tokenizers library), word by word.

The vocabulary's normaliser and splitter never look across ASCII white space, so
a text's ids are those of its words in turn.  Words of ASCII and of Latin-1
letters split further by byte class; each distinct piece is encoded once by the
library's own merge model and kept.  Any other word goes through the library's
whole pipeline, once for each distinct word.
"""

from __future__ import annotations

import os

import numpy as np

from . import kernels as K

#: Byte kinds: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 lead byte of a
#: Latin-1 letter pair, 5 a byte that needs the whole pipeline.
_KIND = np.full(256, 5, np.uint8)
_KIND[:128] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[0xC3] = 4
#: ' starts contractions, < may start a special token; control bytes are left to the library.
_KIND[[0x27, 0x3C, 0x7F, *range(0x00, 0x09), *range(0x0E, 0x20)]] = 5


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    extra = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


class WordBpe:
    """Encoder with a bounded memory of pieces seen; one per Python worker."""

    def __init__(self, path: str, most_kept: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most_kept = most_kept
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        #: The bytes of each piece, and where they begin.
        self.bytes = np.zeros(0, np.uint8)
        self.byte_at = np.zeros(0, np.int64)

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lowered bytes, start, end, whole, first): units to encode; whole: by the whole pipeline."""
        n = len(raw)
        kind = _KIND[raw]
        low = K.lowered(raw)
        lead = np.flatnonzero(kind == 4)
        lead = lead[lead + 1 < n]
        second = raw[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[lead] = np.where(letter, 1, 5)
        kind[lead[letter] + 1] = 1
        kind[kind == 4] = 5
        upper = lead[letter & (second <= 0x9E)] + 1
        low[upper] += 0x20
        # A word with one hard byte is left whole.
        w = K.words(raw, offsets, hashes=False)
        hard = np.zeros(n + 1, np.int64)
        np.cumsum(kind == 5, out=hard[1:])
        is_hard = hard[w.end] > hard[w.start]
        for s, e in zip(w.start[is_hard].tolist(), w.end[is_hard].tolist(), strict=True):
            kind[s:e] = 6
            low[s:e] = raw[s:e]
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[w.start] = True
        start = np.flatnonzero(begins & (kind != 0))
        # A unit ends where the next byte begins another or is white space, or where its text ends.
        stop = begins.copy()
        stop[kind == 0] = True
        cut = offsets[:-1]
        stop[cut[cut < n]] = True
        stops = np.append(np.flatnonzero(stop), n)
        end = stops[np.searchsorted(stops, start, "right")]
        return low, start, end, kind[start] == 6, np.searchsorted(start, offsets)

    def _ids(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids end to end) of pieces."""
        table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        ids: list[list[int]] = [[]] * len(start)
        tokenize = self.model.tokenize
        texts, places = [], []
        for i, (s, e, hard) in enumerate(zip(start.tolist(), end.tolist(), whole.tolist(), strict=True)):
            piece = low[s:e].tobytes()
            if hard:
                texts.append(piece.decode("utf-8", "replace"))
                places.append(i)
            else:
                ids[i] = [t.id for t in tokenize(piece.decode("latin-1").translate(table))]
        if texts:
            for i, got in zip(places, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids[i] = got.ids
        n = np.array([len(x) for x in ids], np.int32)
        return n, np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))

    def _learn(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray, h: np.ndarray) -> None:
        n, flat = self._ids(low, start, end, whole)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate([self.pool, flat])
        size = end - start
        byte_at = len(self.bytes) + np.cumsum(size) - size
        self.bytes = np.concatenate([self.bytes, *(low[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True))])
        order = np.argsort(h)
        where = np.searchsorted(self.hash, h[order])
        self.hash = np.insert(self.hash, where, h[order])
        self.at = np.insert(self.at, where, at[order])
        self.n = np.insert(self.n, where, n[order])
        self.byte_at = np.insert(self.byte_at, where, byte_at[order])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]].

        A piece takes the ids kept under its hash only if its bytes are those kept there.
        """
        if len(raw) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low, start, end, whole, first = self._units(raw, offsets)
        where, back = K.distinct(low, start, end, K.range_hash(low, start, end) ^ whole.astype(np.uint64))
        # A hard piece begins with, or holds, a byte that no other piece has: no piece is both.
        s, e, hard = start[where], end[where], whole[where]
        h = K.range_hash(low, s, e) ^ hard.astype(np.uint64)
        if len(self.hash) + len(h) > self.most_kept:
            self._clear()
        spot = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        known = self.hash[spot] == h if len(self.hash) else np.zeros(len(h), bool)
        clash = known.copy()
        clash[known] = ~K.same_bytes(low, s[known], e[known], self.bytes, self.byte_at[spot[known]])
        if clash.any() or len(np.unique(h)) < len(h):
            n, pool = self._ids(low, s, e, hard)
            at = np.cumsum(n) - n
        else:
            new = np.flatnonzero(~known)
            if len(new):
                self._learn(low, s[new], e[new], hard[new], h[new])
            spot = np.searchsorted(self.hash, h)
            n, at, pool = self.n[spot], self.at[spot], self.pool
        n = n.astype(np.int64)[back]
        at = at[back]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.empty(total, np.uint32)
        for lo in range(0, len(n), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            begin = int(ends[lo] - n[lo])
            count = int(ends[part][-1]) - begin
            ids[begin : begin + count] = pool[np.arange(count) + np.repeat(at[part] - (ends[part] - n[part] - begin), n[part])]
        bounds = np.append(0, ends)[first]
        return ids, bounds


_kept: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _kept:
        _kept[path] = WordBpe(path)
    return _kept[path]
