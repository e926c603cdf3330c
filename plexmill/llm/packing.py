"""Hierarchical multi-length packing.

Documents are routed to context-size tiers (2048, 1024, ... tokens): whole
windows of a long document go to the longest tier, what is left of it and any
shorter document to the smallest tier that holds it.  Each tier is packed from
the longest piece down; the gap of a window is filled from shorter tiers, best
fit first, and the last of it by cutting one piece, so a window is always full
and takes no padding.  Windows are grouped in steps of equal tokens.

Packing works on pools of bounded size inside each input partition, with no
shuffle and no state shared by tasks.  What a partition has left at its end
goes out in windows of powers of two.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import bound_batches

#: Sequence numbers of a partition start at its number times this.
_PER_PARTITION = 1 << 40


@dataclass(frozen=True)
class PackConfig:
    longest: int = 2048
    shortest: int = 256
    end_id: int = 1
    pool_tokens: int = 1 << 21
    step_tokens: int = 1 << 15

    @property
    def tiers(self) -> list[int]:
        out, t = [], self.longest
        while t >= self.shortest:
            out.append(t)
            t //= 2
        return out


@dataclass
class Packer:
    """Packs pieces (document, start, length) of one partition."""

    cfg: PackConfig
    first_sequence: int = 0
    #: Waiting pieces by tier, as sorted (length, document, start).
    waiting: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    made: int = 0
    in_step: int = 0
    step: int = 0

    def __post_init__(self):
        self.waiting = {t: [] for t in self.cfg.tiers}

    def _tier(self, length: int) -> int:
        fit = self.cfg.longest
        while fit // 2 >= max(length, self.cfg.shortest):
            fit //= 2
        return fit

    def _put(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.waiting[self._tier(length)], (length, doc, start))

    def add(self, doc: int, length: int) -> Iterator[tuple]:
        """Route a document; its whole windows go out at once."""
        start = 0
        while length - start >= self.cfg.longest:
            yield from self._window(self.cfg.longest, [(doc, start, self.cfg.longest)])
            start += self.cfg.longest
        self._put(length - start, doc, start)

    def _window(self, size: int, pieces: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """(doc, start, length, sequence, offset, size, step) for each piece of a full window."""
        if self.in_step + size > self.cfg.step_tokens:
            self.step, self.in_step = self.step + 1, 0
        self.in_step += size
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.first_sequence + self.made, offset, size, self.first_sequence + self.step
            offset += length
        self.made += 1

    def _fill(self, gap: int, below: list[int]) -> list[tuple[int, int, int]] | None:
        """Pieces of just `gap` tokens from the tiers `below`, the last one cut if need be."""
        got: list[tuple[int, int, int]] = []
        while gap:
            for t in below:
                q = self.waiting[t]
                at = bisect_right(q, (gap, 1 << 62, 0))
                if at:
                    length, doc, start = q.pop(at - 1)
                    got.append((doc, start, length))
                    gap -= length
                    break
            else:
                for t in reversed(below):
                    if self.waiting[t]:
                        length, doc, start = self.waiting[t].pop(0)
                        got.append((doc, start, gap))
                        self._put(length - gap, doc, start + gap)
                        gap = 0
                        break
                else:
                    for doc, start, length in got:
                        self._put(length, doc, start)
                    return None
        return got

    def pack(self) -> Iterator[tuple]:
        """Pack every tier, longest first, as far as its windows can be filled."""
        tiers = self.cfg.tiers
        for i, size in enumerate(tiers):
            q = self.waiting[size]
            while q:
                length, doc, start = q.pop()
                rest = self._fill(size - length, tiers[i:])
                if rest is None:
                    insort(q, (length, doc, start))
                    break
                yield from self._window(size, [(doc, start, length), *rest])

    def finish(self) -> Iterator[tuple]:
        """Pack what is left: windows of ever smaller powers of two, each full."""
        yield from self.pack()
        left = sorted((p for q in self.waiting.values() for p in q), reverse=True)
        self.waiting = {t: [] for t in self.cfg.tiers}
        total = sum(p[0] for p in left)
        size = self.cfg.longest
        while total:
            while size > total:
                size //= 2
            window, room = [], size
            while room:
                length, doc, start = left.pop(0)
                take = min(length, room)
                window.append((doc, start, take))
                if take < length:
                    left.insert(0, (length - take, doc, start + take))
                room -= take
            yield from self._window(size, window)
            total -= size


def pack(docs: DataFrame, vocabulary: str, cfg: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset, window, step.

    `vocabulary` is the path of a word-end BPE file.  A document's ids end with
    `cfg.end_id`.  Each id lies in one piece; each window is full.  Defined cases:
    a null or empty text has only the end id; a null doc_id stays null; rows that
    repeat a doc_id are packed as often as they occur, each with starts of its own;
    an empty table gives no piece; other columns are ignored; a long text is read in
    pieces, its ids wait in the task that packs them.
    """

    bound_batches(docs.sparkSession)
    def run(batches):
        from .wordbpe import encoder

        enc = encoder(vocabulary)
        packer = Packer(cfg, TaskContext.get().partitionId() * _PER_PARTITION)
        ids: dict[int, np.ndarray] = {}
        left: dict[int, int] = {}
        name: dict[int, int | None] = {}
        total: dict[int, int] = {}
        seen = pool = 0

        def out(rows):
            rows = list(rows)
            if not rows:
                return
            doc, start, length, seq, offset, size, step = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name[d] for d in doc], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([ids[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
                    pa.array([total[d] for d in doc], pa.int64()),
                    pa.array(seq, pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array(size, pa.int32()),
                    pa.array(step, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step"],
            )
            for d, n in zip(doc, length, strict=True):
                left[d] -= n
                if not left[d]:
                    del left[d], ids[d], name[d], total[d]

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            held: list[np.ndarray] = []  # ids of the pieces of a long text
            for lo, hi, raw, offs, more in K.row_pieces(batch.column("text")):
                tokens, bounds = enc.encode(raw, offs)
                if more or held:
                    held.append(tokens)
                if more:
                    continue
                if held:
                    tokens, held = np.concatenate(held), []
                    bounds = np.array([0, len(tokens)])
                rows: list[tuple] = []
                for i in range(hi - lo):
                    own = np.append(tokens[bounds[i] : bounds[i + 1]], np.uint32(cfg.end_id)).astype("<u4")
                    ids[seen], name[seen], total[seen], left[seen] = own, names[lo + i], len(own), len(own)
                    rows.extend(packer.add(seen, len(own)))
                    pool += len(own)
                    seen += 1
                if pool >= cfg.pool_tokens:
                    rows.extend(packer.pack())
                    pool = 0
                yield from out(rows)
        yield from out(packer.finish())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step long",
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "window",
        "step",
    )
