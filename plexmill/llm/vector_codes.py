"""Codes of vectors by entries of small codebooks, searched by annuli of norms.

A vector's integer components are cut into equal parts; each part position has a codebook
that rounds of k-means move.  By the triangle inequality an entry at distance d from a part
has a norm within d of the part's.  So a codebook's entries are sorted by norm; the entry of
the next norm gives a first distance, a binary search finds the interval of norms that it
allows, ends included, and only that annulus is evaluated, in integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Workspace


@dataclass(frozen=True)
class CodeConfig:
    parts: int = 8
    entries: int = 16  # 256 at most: two hex digits
    rounds: int = 6
    scale: int = 4096
    rows_at_once: int = 4096


class Codebook:
    """Entries of one part position, as an array of (entry, component)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        exact = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.argsort(exact, kind="stable")
        self.norms = exact[self.order]
        self.evaluated = 0  # distances computed so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x; of equally near entries the lowest."""
        m = len(self.order)
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        begin = np.minimum(np.searchsorted(self.norms, norm), m - 1)
        best = self.order[begin]
        far = self._squared(x, best)
        lo, hi = self._annulus(norm, far)
        for step in range(1, m):  # outwards from the first entry, while the annulus, which shrinks, reaches as far
            rest = np.flatnonzero((begin + step < hi) | (begin - step >= lo))
            if not len(rest):
                break
            for at in (begin + step, begin - step):
                rows = rest[(at[rest] < hi[rest]) & (at[rest] >= lo[rest])]
                entry = self.order[at[rows]]
                d = self._squared(x[rows], entry)
                better = (d < far[rows]) | ((d == far[rows]) & (entry < best[rows]))
                rows = rows[better]
                best[rows], far[rows] = entry[better], d[better]
                lo[rows], hi[rows] = self._annulus(norm[rows], far[rows])
        return best, far

    def _annulus(self, norm: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of entries, by norm, that may be as near as the best so far; both ends count."""
        reach = np.sqrt(far.astype(np.float64))
        slack = 1e-9 * (norm + reach) + 1e-6  # wider than the rounding of the roots
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")

    def _squared(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.evaluated += len(x)
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)


def most_component(dim: int) -> int:
    """Largest integer component for which squared distances of `dim` components stay below 2^62."""
    return isqrt((1 << 62) // max(1, dim)) // 2


def _integers(cfg: CodeConfig):
    """Rows to (vec_id, label, dim, components as 64-bit integers); rows that can't be coded go."""

    def run(it):
        for batch in it:
            col = batch.column("embedding")
            ids, bytes_, dims = [], [], []
            for i, v in enumerate(col):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy()
                dim = len(x)
                if dim % cfg.parts or not np.isfinite(x).all():
                    continue
                x = np.floor(x * float(cfg.scale))
                if not (np.abs(x) <= most_component(dim)).all():
                    continue
                ids.append(i)
                dims.append(dim)
                bytes_.append(x.astype("<i8").tobytes())
            if ids:
                at = pa.array(ids, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(dims, pa.int32()), pa.array(bytes_, pa.binary())],
                    ["vec_id", "label", "dim", "vector"],
                )

    return run


def _parts(vectors: pa.Array, cfg: CodeConfig, lo: int) -> np.ndarray:
    """(row, part, component) of some rows."""
    own = vectors.slice(lo, cfg.rows_at_once).to_pylist()
    return np.frombuffer(b"".join(own), "<i8").reshape(len(own), cfg.parts, -1)


def _sums(books: list[np.ndarray], cfg: CodeConfig):
    """Vectors to (part, entry, position, total, n), a row for each component of each used entry."""

    def run(it):
        search = [Codebook(b) for b in books]
        totals = np.zeros((cfg.parts, len(books[0]), books[0].shape[1]), np.int64)
        counts = np.zeros((cfg.parts, len(books[0])), np.int64)
        for batch in it:
            for lo in range(0, batch.num_rows, cfg.rows_at_once):
                x = _parts(batch.column("vector"), cfg, lo)
                for p in range(cfg.parts):
                    entry, _ = search[p].nearest(x[:, p])
                    np.add.at(totals[p], entry, x[:, p])
                    counts[p] += np.bincount(entry, minlength=len(books[0]))
        p, e = np.nonzero(counts)
        width = totals.shape[2]
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(p, width).astype(np.int32)),
                    pa.array(np.repeat(e, width).astype(np.int32)),
                    pa.array(np.tile(np.arange(width), len(p)).astype(np.int32)),
                    pa.array(totals[p, e].reshape(-1)),
                    pa.array(np.repeat(counts[p, e], width)),
                ],
                ["part", "entry", "position", "total", "n"],
            )

    return run


def _coded(books: list[np.ndarray], cfg: CodeConfig):
    """Vectors to (vec_id, label, code, error)."""

    def run(it):
        search = [Codebook(b) for b in books]
        for batch in it:
            for lo in range(0, batch.num_rows, cfg.rows_at_once):
                x = _parts(batch.column("vector"), cfg, lo)
                entry, far = zip(*(search[p].nearest(x[:, p]) for p in range(cfg.parts)), strict=True)
                codes = np.stack(entry, axis=1).astype(np.uint8)
                own = batch.slice(lo, cfg.rows_at_once)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(far))],
                    ["vec_id", "label", "code", "error"],
                )

    return run


@dataclass
class Codes:
    """rows: vec_id, label, code, error.  books: by part position the entries, (entry, component)."""

    rows: DataFrame
    books: list[np.ndarray]

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, cfg: CodeConfig = CodeConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Codes:
    """Codebooks of `vectors` and a code for each.

    A component x counts as floor(scale * x).  Codebooks start from the parts of the rows of
    the smallest ids; each round assigns all parts, then moves each used entry to the floor of
    its parts' mean.  Sums are taken by tasks and added by Spark; to the driver go the
    `entries` * components sums of a round, whatever the number of rows.  Defined cases: a
    vector that is null, empty or holds a null or non-finite component is left out, as is one
    whose length is no multiple of `parts` or differs from that of the row of the smallest id,
    and one with a component beyond `most_component`, whose distances exceed a long; a null id
    comes after all others; rows that repeat an id are vectors of their own, ordered by their
    components among the starting entries; fewer rows than `entries` make as many entries; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "codes")
    raw = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    )
    label = raw.schema["label"].dataType
    schema = T.StructType([raw.schema["vec_id"], T.StructField("label", label)])
    rows = work.save(raw.mapInArrow(_integers(cfg), T.StructType([*schema]).add("dim", T.IntegerType()).add("vector", T.BinaryType())), "integers")
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*by_id).limit(1).collect()
    coded = T.StructType([*schema]).add("code", T.StringType()).add("error", T.LongType())
    if not first:
        return Codes(spark.createDataFrame([], coded), [])
    rows = rows.where(F.col("dim") == first[0].dim)
    start = np.stack([np.frombuffer(r.vector, "<i8") for r in rows.orderBy(*by_id).limit(cfg.entries).collect()])
    start = start.reshape(len(start), cfg.parts, -1)
    books = [start[:, p].copy() for p in range(cfg.parts)]
    for _ in range(cfg.rounds):
        sums = rows.select("vector").mapInArrow(_sums(books, cfg), "part int, entry int, position int, total long, n long")
        moved = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.part][r.entry, r.position] = r.total // r.n
        still = all((a == b).all() for a, b in zip(books, moved, strict=True))
        books = moved
        if still:  # every later round would give the same
            break
    return Codes(rows.select("vec_id", "label", "vector").mapInArrow(_coded(books, cfg), coded), books)


def digest(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of the label; null is a label), codebooks_sha256."""
    by = codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    rows = codes.rows.join(by, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
