"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a range of rows at once: texts are
joined in one byte array, words are found by byte class, and each word gets a
keyed 64-bit hash of its bytes, taken eight at a time.  Nothing here loops over
words in Python, but for the few that are long.  No table outlives a call, and
what a call holds beside its result is a few bytes for each byte of text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Keys of the word hash, from a seed.
_KEY = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_KEY_BYTES = _KEY.tobytes()[:16]
#: Words longer than this are hashed one by one.
_LONG = 64
#: Words that are hashed at once.
_STEP = 1 << 15
#: By number of bytes taken: a mask for the low ones.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

#: Byte classes (True: part of a word).
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_ranges(column: pa.Array, most: int = 1 << 19):
    """(lo, hi, bytes, offsets) for ranges of rows of about `most` bytes, one row at least."""
    raw, offs = text_buffer(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


#: ASCII but white space and control characters: what stands on both sides of a cut.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


def row_pieces(column: pa.Array, most: int = 1 << 19):
    """As `row_ranges`, with more: a row above 2 * `most` bytes comes in pieces, more is set on all but its last.

    A piece ends before a single blank between two printable ASCII characters, where no
    word, pre-token or token goes across; a row without such a place comes whole.
    """
    for lo, hi, raw, offs in row_ranges(column, most):
        at, n = 0, len(raw)
        while n - at > 2 * most:
            found = -1
            for a in range(at + most, n - 1, most):  # a: first place that may be a cut
                part = raw[a - 1 : min(n, a + most + 1)]
                ok = np.flatnonzero((part[1:-1] == 0x20) & _SOLID[part[:-2]] & _SOLID[part[2:]])
                if len(ok):
                    found = a + int(ok[0])
                    break
            if found < 0:
                break
            yield lo, hi, raw[at:found], np.array([0, found - at]), True
            at = found
        yield lo, hi, raw[at:], offs - at if at == 0 else np.array([0, n - at]), False


@dataclass
class Words:
    """Words of a batch: byte ranges, hashes and, per text, the range of words."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1; text i has words first[i]:first[i + 1]
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def range_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hash of each byte range, the same wherever the bytes lie.

    Eight bytes at a time are mixed into the state, so no sum over a range's bytes, whose
    terms could be moved about, decides; ranges of over `_LONG` bytes take BLAKE2.
    """
    m = len(start)
    out = np.empty(m, np.uint64)
    if m == 0:
        return out
    if len(raw) < 8:
        raw = np.concatenate([raw, np.zeros(8 - len(raw), np.uint8)])
    n = len(raw)
    at8 = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for lo in range(0, m, _STEP):
        s, e = start[lo : lo + _STEP], end[lo : lo + _STEP]
        length = e - s
        h = mix64(length.astype(np.uint64) * _KEY[0] + _KEY[1])
        live, k = np.flatnonzero((length > 0) & (length <= _LONG)), 0
        while len(live):
            at = s[live] + k
            # The last bytes of the buffer are read from eight before its end, and shifted down.
            late = np.maximum(at - (n - 8), 0)
            eight = at8[at - late].view("<u8").ravel() >> (late.astype(np.uint64) * np.uint64(8))
            eight &= _MASK[np.minimum(length[live] - k, 8)]
            h[live] = mix64((h[live] ^ mix64(eight + _KEY[2])) * _KEY[3])
            k += 8
            live = live[length[live] > k]
        for i in np.flatnonzero(length > _LONG).tolist():
            digest = hashlib.blake2b(raw[s[i] : e[i]], digest_size=8, key=_KEY_BYTES).digest()
            h[i] = int.from_bytes(digest, "little")
        out[lo : lo + _STEP] = h
    return out


def same_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether raw[start:end] and the bytes of `other` from `at` on are the same, for each range."""
    length = end - start
    same = at + length <= len(other)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    other = np.concatenate([other, np.zeros(8, np.uint8)])
    x, y = (np.lib.stride_tricks.sliding_window_view(b, 8) for b in (raw, other))
    for lo in range(0, len(start), _STEP):
        part = slice(lo, lo + _STEP)
        s, o, n, ok = start[part], at[part], length[part], same[part]
        live, k = np.flatnonzero(ok & (n > 0)), 0
        while len(live):
            differ = x[s[live] + k].view("<u8").ravel() ^ y[o[live] + k].view("<u8").ravel()
            differ &= _MASK[np.minimum(n[live] - k, 8)]
            ok[live[differ != 0]] = False
            k += 8
            live = live[(differ == 0) & (n[live] > k)]
    return same


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(where, back): the place of one of each distinct byte range, and for each range its number among these.

    Found by hash, in the order of hashes, and held against the bytes; ranges whose bytes
    aren't those of their hash's first one are numbered by their bytes.
    """
    if hashes is None:
        hashes = range_hash(raw, start, end)
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    like = where[back]
    odd = np.flatnonzero((end - start != end[like] - start[like]) | ~same_bytes(raw, start, end, raw, start[like]))
    more: dict[bytes, int] = {}
    for i in odd.tolist():
        k = more.setdefault(raw[start[i] : end[i]].tobytes(), len(where))
        if k == len(where):
            where = np.append(where, i)
        back[i] = k
    return where, back


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACE_WORDS, hashes: bool = True) -> Words:
    """Maximal runs of word bytes, never across two texts."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    is_in = inside[raw]
    begins = np.empty(n, bool)
    begins[0] = is_in[0]
    np.logical_and(is_in[1:], ~is_in[:-1], out=begins[1:])
    ends = np.empty(n, bool)
    ends[-1] = is_in[-1]
    np.logical_and(is_in[:-1], ~is_in[1:], out=ends[:-1])
    cut = offsets[:-1]
    cut = cut[cut < n]
    begins[cut] |= is_in[cut]
    before = cut[cut > 0] - 1
    ends[before] |= is_in[before]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(raw, start, end, first, range_hash(raw, start, end) if hashes else np.zeros(0, np.uint64))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each text's distinct shingles, ordered by text and hash.

    A text with fewer than `size` words has its whole sequence as one shingle;
    a text without words has none.
    """
    counts = w.counts()
    n_texts = len(counts)
    take = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(take.sum())
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cut = np.append(0, np.cumsum(take))
    h = np.zeros(total, np.uint64)
    last = len(w.hash) - 1
    for lo in range(0, total, _STEP):
        place = np.arange(lo, min(total, lo + _STEP))
        text = np.searchsorted(cut, place, "right") - 1
        at = place - cut[text] + w.first[text]
        length = np.minimum(counts, size)[text]
        part = np.zeros(len(place), np.uint64)
        for i in range(size):
            word = w.hash[np.minimum(at + i, last)] * np.uint64(2 * i + 3)
            part = np.where(i < length, mix64(part * np.uint64(0x9FB21C651E98DF25) + word), part)
        h[lo : lo + _STEP] = part
    if n_texts == 1:
        h.sort()
        owner = np.zeros(total, np.int64)
    else:
        owner = np.repeat(np.arange(n_texts), take)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
    keep = np.ones(total, bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[keep], h[keep]


def sorted_groups(batches, keys: list[str]):
    """Record batches of one group each, from batches sorted by long or int `keys`.

    Only the group at hand is held in memory.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist(), n]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(k[lo])
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
