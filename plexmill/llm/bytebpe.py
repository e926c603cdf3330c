"""Byte-level BPE by a global shuffle of distinct words.

Each block of documents is split into pre-tokens, and kept as positions: a code
for each pre-token, the codes numbering the block's distinct pre-tokens.  These
distinct pre-tokens alone are shuffled by their hash to buckets, where each word
of the corpus is encoded once, whatever blocks it comes from.  The ids go back
to the blocks that asked, and every document is put together by position.
Texts are split twice, once for the words and once for the positions: keeping
the positions meanwhile would take more disk than the texts themselves.  An input
that isn't a plain scan of files is written to the shared folder first, so that
both readings give the same blocks.  Decoding looks ids up in the table of token
bytes.

A frequent word costs one entry a block, so no bucket or block gets more than
its share.  Words are told apart by their bytes.  A block is some megabytes of
texts, one document at least; a bucket's words pass by, and the memory of those
encoded is bounded.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Workspace, bound_batches, rereadable


@dataclass(frozen=True)
class BpeConfig:
    block_mb: int = 4
    step_kb: int = 512
    buckets_per_partition: int = 2
    most_buckets: int = 65_535  # numbers of buckets take two bytes
    most_known: int = 400_000  # words of a bucket kept with their ids at once


#: Character kinds below U+0250, where Unicode is settled: space, letter, number, other.
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_SETTLED = 0x250


@cache
def _kinds() -> np.ndarray:
    import unicodedata

    kind = np.full(_SETTLED, _OTHER, np.uint8)
    for c in range(_SETTLED):
        major = unicodedata.category(chr(c))[0]
        kind[c] = _LETTER if major == "L" else _NUMBER if major == "N" else _OTHER
    kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
    return kind


def _settled_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points below U+0250, texts at `bounds`.

    A run of letters, of numbers or of other characters takes one blank before it;
    a run of white space leaves its last character to what follows; an apostrophe
    that begins a token takes one of the contractions s t re ve m ll d with it.
    """
    n = len(points)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
    ends = np.ones(n, bool)  # the text ends here
    ends[:-1] = first[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 0x20) & ~first[1:]
    space = kind == _SPACE
    last_space = space & ~ends
    last_space[:-1] &= ~space[1:]
    begins = np.where(space, ~same | last_space, ~same & ~after_blank)

    # Contractions: a lone apostrophe that starts a token, then letters of the list.
    def at(i: np.ndarray, shift: int) -> np.ndarray:
        j = np.minimum(i + shift, n - 1)
        inside = (i + shift < n) & ~np.logical_or.reduce([first[np.minimum(i + k, n - 1)] for k in range(1, shift + 1)])
        return np.where(inside, points[j], 0)

    quote = np.flatnonzero((points == 0x27) & begins)
    if len(quote):
        a, b = at(quote, 1), at(quote, 2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        length = np.where(one, 1, np.where(two, 2, 0))
        hit, length = quote[length > 0], length[length > 0]
        begins[hit + 1] = False
        then = hit + 1 + length
        then = then[then < n]
        begins[then] |= ~(first[then] | space[then]) | begins[then]
    begins |= first
    return np.flatnonzero(begins)


@cache
def _splitter(pattern: str):
    import regex

    # \s as the White_Space property, which the regex module would widen by U+001C to U+001F.
    blank = r"\t-\r \x85\xa0  -     　"
    return regex.compile(pattern.replace(r"[^\s", rf"[^{blank}").replace(r"\s", rf"[{blank}]").replace(r"\S", rf"[^{blank}]"))


def pre_tokens(raw: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the pre-tokens; text i has first[i]:first[i + 1]."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    bounds = np.searchsorted(byte_at, offsets)
    wild = np.zeros(len(points) + 1, np.int64)
    np.cumsum(points >= _SETTLED, out=wild[1:])
    odd = np.flatnonzero(wild[bounds[1:]] > wild[bounds[:-1]])
    starts = _settled_starts(np.where(points < _SETTLED, points, 0x41), bounds[:-1][bounds[:-1] < len(points)])
    if len(odd):
        keep = np.ones(len(points), bool)
        extra = []
        find = _splitter(pattern).finditer
        for i in odd.tolist():
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            keep[lo:hi] = False
            text = points[lo:hi].tobytes().decode("utf-32-le")
            extra.append(np.array([lo + m.start() for m in find(text)], np.int64))
        starts = np.sort(np.concatenate([starts[keep[starts]], *extra]))
    start = byte_at[starts]
    end = np.append(start[1:], len(raw))
    return start, end, np.searchsorted(start, offsets)


_squeeze = zstandard.ZstdCompressor(level=3)


def _packed(*parts) -> bytes:
    return _squeeze.compress(pickle.dumps(parts, protocol=5))


def _unpacked(data) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _planes(codes: np.ndarray) -> list[bytes]:
    """The bytes of codes, one plane for each place: high planes are nearly constant."""
    b = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [b[:, i].tobytes() for i in range(4)]


def _from_planes(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)


def _gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): pool[at[i]:at[i] + n[i]] for all i, end to end."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(at - (ends - n), n)], ends


_SCHEMA = "kind string, block long, bucket int, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, block, bucket, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
        ["kind", "block", "bucket", "payload"],
    )


def _exploded(pattern: str, cfg: BpeConfig, buckets: int, kind: str):
    """Documents to blocks: one row of positions, or rows of distinct words by bucket.

    A block's number is its partition's and its place there.  Beside it goes a hash of
    its distinct words, so that rows of another reading can't be taken for its own.
    """

    def block_rows(parts: list[tuple], block: int) -> list[tuple]:
        """parts: per piece (distinct words as bytes, sizes, ends), hash of each, counts, codes, and documents' names and pre-tokens."""
        data = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts])
        ends = np.cumsum(size)
        hashes = np.concatenate([p[2] for p in parts])
        where, back = K.distinct(data, ends - size, ends, hashes)
        freq = np.bincount(back, np.concatenate([p[3] for p in parts]), len(where))
        order = np.argsort(-freq, kind="stable")
        code = np.empty(len(where), np.int64)
        code[order] = np.arange(len(where))
        words = hashes[where[order]]
        bucket = (words % np.uint64(buckets)).astype(np.uint16)
        check = int(K.mix64(words + np.arange(len(words), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
        if kind == "codes":
            first_of = np.cumsum([0, *(len(p[1]) for p in parts)])
            codes = np.concatenate([code[back[first_of[k] : first_of[k + 1]]][p[4]].astype(np.uint32) for k, p in enumerate(parts)])
            ids = [d for p in parts for d in p[5]]
            counts = np.concatenate([p[6] for p in parts])
            return [("codes", block, -1, _packed(check, ids, counts, _planes(codes), bucket))]
        raw = data.tobytes()
        begin, end = (ends - size)[where[order]], ends[where[order]]
        rows = []
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = [raw[s:e] for s, e in zip(begin[by[lo:hi]].tolist(), end[by[lo:hi]].tolist(), strict=True)]
            rows.append(("words", block, int(bucket[by[lo]]), _packed(check, b"".join(own), np.array([len(t) for t in own], np.uint32))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held, block = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            begun = False  # the piece goes on with the document of the piece before
            for lo, hi, raw, offs, more in K.row_pieces(batch.column("text"), cfg.step_kb << 10):
                start, end, first = pre_tokens(raw, offs, pattern)
                h = K.range_hash(raw, start, end)
                where, back = K.distinct(raw, start, end, h)
                text = [raw[s:e] for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)]
                parts.append(
                    (
                        np.concatenate(text) if text else np.zeros(0, np.uint8),
                        (end - start)[where],
                        h[where],
                        np.bincount(back, minlength=len(where)),
                        back.astype(np.uint32),
                        [] if begun else names[lo:hi],
                        np.diff(first),
                    )
                )
                if begun:  # one document: its pre-tokens add up
                    before = parts[-2][6]
                    parts[-2] = (*parts[-2][:6], before[:-1])
                    parts[-1] = (*parts[-1][:6], before[-1:] + parts[-1][6])
                begun = more
                held += len(raw)
                if held >= cfg.block_mb << 20 and not more:
                    if rows := block_rows(parts, block):  # none of a block without pre-tokens
                        yield _rows(rows)
                    parts, held, block = [], 0, block + 1
        if parts and (rows := block_rows(parts, block)):
            yield _rows(rows)

    return run


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, start, length) of the bytes of each id."""
    by_id = {r: t for t, r in ranks(path).items()}
    size = max(by_id) + 1
    n = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
    return np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8), np.cumsum(n) - n, n


def _encoded(path: str, pattern: str, cfg: BpeConfig):
    """Words of a bucket to ids, each distinct word encoded once; rows sorted by bucket.

    A bucket of more than `most_known` distinct words forgets some, and may encode them again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path, pattern)
        wide = "<u2" if enc.n_vocab <= 1 << 16 else "<u4"
        known: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for block, bucket, payload in zip(*(batch.column(c) for c in ("block", "bucket", "payload")), strict=True):
                block, bucket = block.as_py(), bucket.as_py()
                if bucket != at or len(known) > cfg.most_known:
                    known, at = {}, bucket
                check, text, length = _unpacked(payload.as_buffer())
                ends = np.cumsum(length)
                words = [text[s:e] for s, e in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                new = [w for w in words if w not in known]
                if new:
                    for w, ids in zip(new, enc.encode_ordinary_batch([w.decode("utf-8") for w in new], num_threads=1), strict=True):
                        known[w] = np.array(ids, wide).tobytes()
                got = [known[w] for w in words]
                n = np.array([len(g) for g in got], np.uint32) // np.dtype(wide).itemsize
                yield _rows([("ids", block, bucket, _packed(check, b"".join(got), n, wide))])

    return run


def _binary(cuts: np.ndarray, parts: list[bytes]) -> pa.Array:
    """The bytes of `parts`, end to end, as one value from each cut to the next."""
    offsets = pa.py_buffer(cuts.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(b"".join(parts))])


#: Pre-tokens that are put together at once.
_STEP = 1 << 16


def _assembled(path: str):
    """Blocks (one row of positions, then rows of ids by bucket) to documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, positions, words = None, None, {}
        for batch in batches:
            for block, bucket, payload in zip(*(batch.column(c) for c in ("block", "bucket", "payload")), strict=True):
                block, bucket = block.as_py(), bucket.as_py()
                if block != at:
                    if positions:
                        yield from documents(positions, words)
                    at, positions, words = block, None, {}
                if bucket < 0:
                    positions = _unpacked(payload.as_buffer())
                else:
                    words[bucket] = _unpacked(payload.as_buffer())
        if positions:
            yield from documents(positions, words)

    def documents(positions, words):
        pool, byte_at, byte_n = _token_bytes(path)
        check, names, counts, planes, bucket_of = positions
        if set(np.unique(bucket_of).tolist()) != set(words) or any(w[0] != check for w in words.values()):
            raise RuntimeError("a block's words are missing: the input gives other rows when read again")
        codes = _from_planes(planes)
        n = np.zeros(len(bucket_of), np.int64)
        at = np.zeros(len(bucket_of), np.int64)
        ids, filled = [], 0
        for b, (_, data, own, wide) in sorted(words.items()):
            mine = np.flatnonzero(bucket_of == b)
            n[mine] = own
            at[mine] = filled + np.cumsum(own, dtype=np.int64) - own
            ids.append(np.frombuffer(data, wide))
            filled += len(ids[-1])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        doc_ends = np.cumsum(counts)
        lo = 0
        while lo < len(names):  # some documents at a time, and some pre-tokens at a time, to bound memory
            begin = doc_ends[lo] - counts[lo]
            hi = max(lo + 1, int(np.searchsorted(doc_ends, begin + _STEP, "right")))
            numbers, texts, cut, byte_cut = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
            done = byte_done = 0
            for a in range(begin, doc_ends[hi - 1], _STEP):
                part = codes[a : min(a + _STEP, doc_ends[hi - 1])]
                tokens, ends = _gather(ids, at[part], n[part])
                text, byte_ends = _gather(pool, byte_at[tokens], byte_n[tokens])
                numbers.append(tokens.astype("<u4").tobytes())
                texts.append(text.tobytes())
                cut.append(done + ends)
                byte_cut.append(byte_done + np.append(0, byte_ends)[ends])
                done, byte_done = done + len(tokens), byte_done + len(text)
            # Ends of the documents, in tokens and in bytes.
            stops = np.append(0, np.cumsum(counts[lo:hi]))
            cut, byte_cut = np.concatenate(cut)[stops], np.concatenate(byte_cut)[stops]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[lo:hi], pa.int64()),
                    pa.array(np.diff(cut)),
                    _binary(4 * cut, numbers),
                    _binary(byte_cut, texts),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )
            lo = hi

    return run


def encode_and_decode(
    docs: DataFrame, rank_file: str, pattern: str, cfg: BpeConfig = BpeConfig(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian), decoded (bytes) for each row of `docs`.

    Ids are those of the tiktoken library for the rank file and pattern, without
    special tokens.  Defined cases: a null or empty text has no ids and decodes to no
    bytes; a null doc_id stays null; repeated rows are returned as often as they
    occur; an empty table gives an empty result; other columns are ignored.  A text is
    split in pieces of `cfg.step_kb`, cut at blanks; its ids and bytes are held whole
    by the task that returns it.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not rereadable(rows):
        rows = Workspace(docs.sparkSession, "bpe").save(rows, "texts")
    partitions = max(1, rows.rdd.getNumPartitions())
    buckets = min(cfg.most_buckets, max(8, cfg.buckets_per_partition * partitions))
    blocks = lambda kind: rows.mapInArrow(_exploded(pattern, cfg, buckets, kind), _SCHEMA)
    words = blocks("words").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encoded(rank_file, pattern, cfg), _SCHEMA)
    codes = blocks("codes")
    # Blocks are put together by the input's partitions, so no task gets more than a partition's share.  Positions stand
    # first in the union: their tasks have the numbers of the input's partitions, as those of the words had.
    both = codes.unionByName(ids).select("block", "bucket", "payload")
    both = both.repartitionById(partitions, F.shiftright("block", 32).cast("int")).sortWithinPartitions("block", "bucket")
    return both.mapInArrow(_assembled(rank_file), "doc_id long, n_tokens long, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
