"""Embedding near-dedup: spherical k-means cells, blocked cosines within cells.

Equal vectors of one label are one class.  Spherical k-means, fitted on a bounded
sample, gives every class a home cell; a cell holds one label.  Two vectors within
the angle of the threshold may have other homes, so a class also visits the cells
of lower number that a partner may live in.  With centroids a (home) and b, a
partner at angle t of x lies nearer to b just if cos t * m < sin t * z, where m is
x's distance from the border, x . (a - b) / |a - b|, and z is the part of the
partner's direction across it.  z is at most 1 (`spread` None: no link is lost),
but for directions at random in d dimensions its standard deviation is 1 / sqrt(d - 1);
`spread` standard deviations are allowed for, so a link of the least cosine is lost
with a chance of 0.6 % for each border near by, a link of a greater one with less.
Every pair meets in one cell at most, the lower of the two homes.  Cells are split in
blocks of bounded size; a block returns link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .storage import Workspace


@dataclass(frozen=True)
class CosineConfig:
    threshold: float = 0.93
    cell_rows: int = 2048  # aimed at, over all labels
    most_cells: int = 4096  # beyond as many cells grow with the input
    spread: float | None = 2.5  # standard deviations of a partner's direction across a border; None: any direction
    sample: int = 20_000  # vectors that k-means is fitted on
    rounds: int = 10
    block: int = 1024
    seed: int = 9


def _clean(cfg: CosineConfig):
    """Rows to (vec_id, label, dim, vector as doubles); rows that can't link have no vector."""

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            col = batch.column("embedding")
            col = col.cast(pa.list_(pa.float64()))
            bounds = col.offsets.to_numpy()
            flat = col.values
            values = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            null_at = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(~np.isfinite(np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)), out=null_at[1:])
            here = col.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            here &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            out = []
            for i in range(batch.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                x = values[lo:hi]
                ok = here[i] and hi > lo and null_at[hi] == null_at[lo] and np.any(x != 0)
                out.append((x + 0.0).astype("<f8").tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"]
            )

    return run


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of the unit rows of x; empty cells take the row that fits worst."""
    g = np.random.Generator(np.random.PCG64(seed))
    c = x[g.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sim = x @ c.T
        home = sim.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        worst = np.argsort(sim[np.arange(len(x)), home])
        for n, empty in enumerate(np.flatnonzero(size < 1e-9)):
            sums[empty], size[empty] = x[worst[n]], 1.0
        c = sums / size[:, None]
    return c


def margin(cfg: CosineConfig, dim: int) -> float:
    """Distance from a border within which a vector of `dim` components visits the cell behind it."""
    far = np.sqrt(1 - cfg.threshold**2)
    if cfg.spread is None or dim < 2:
        return far + 1e-9
    return min(far, far / cfg.threshold * cfg.spread / np.sqrt(dim - 1)) + 1e-9


#: Rows that are held against all centroids at once.
_ROWS = 512


def _cells(centroids: dict[int, np.ndarray], cfg: CosineConfig):
    """Classes to (label, dim, cell, visit, node, copies, vector): the home and the cells visited."""

    def run(it):
        apart: dict[int, np.ndarray] = {}
        for batch in it:
            by: dict[int, list[int]] = {}
            vectors = batch.column("vector").to_pylist()
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for dim, every in by.items():
                c = centroids[dim]
                if dim not in apart:
                    apart[dim] = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                within = margin(cfg, dim // 8)
                for lo in range(0, len(every), _ROWS):
                    rows = every[lo : lo + _ROWS]
                    x = _unit([vectors[i] for i in rows])
                    sim = x @ c.T
                    home = sim.argmax(axis=1)
                    own = sim[np.arange(len(rows)), home]
                    near = own[:, None] - sim <= within * apart[dim][home] + 1e-9
                    near &= np.arange(len(c))[None, :] < home[:, None]
                    r, cell = np.nonzero(near)
                    at = np.concatenate([np.arange(len(rows)), r])
                    take = pa.array(np.array(rows)[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("label").take(take),
                            pa.array(np.full(len(at), dim, np.int32)),
                            pa.array(np.concatenate([home, cell]).astype(np.int32)),
                            pa.array(np.arange(len(at)) >= len(rows)),
                            batch.column("node").take(take),
                            batch.column("copies").take(take),
                            pa.array([x[i].tobytes() for i in at], pa.binary()),
                        ],
                        ["label", "dim", "cell", "visit", "node", "copies", "vector"],
                    )

    return run


_BLOCK = ["label", "dim", "cell", "i", "j"]


def _blocks(cfg: CosineConfig):
    """Blocks to (node, links, root): links are counted in copies; root is a node in reach."""

    def run(it):
        for t in K.sorted_groups(it, _BLOCK):
            line = t.column("line").to_numpy(zero_copy_only=False)
            node = t.column("node").to_numpy()
            copies = t.column("copies").to_numpy()
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(len(node), -1)
            a, b = np.flatnonzero(line), np.flatnonzero(~line)
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()  # a block against itself
            if not len(a) or not (same or len(b)):
                continue
            if same:
                b = a
            linked = x[a] @ x[b].T >= cfg.threshold
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(node), np.int64)
            links[a] += linked @ copies[b]
            if not same:
                links[b] += copies[a] @ linked
            root = np.full(len(node), -1, np.int64)
            free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
            for s in np.flatnonzero(linked.any(axis=1)):
                if not free_a[s]:
                    continue
                front = np.array([s])
                free_a[s] = False
                root[a[s]] = node[a[s]]
                while len(front):
                    reach = np.flatnonzero(linked[front].any(axis=0) & free_b)
                    free_b[reach] = False
                    root[b[reach]] = node[a[s]]
                    front = np.flatnonzero(linked[:, reach].any(axis=1) & free_a) if len(reach) else reach
                    free_a[front] = False
                    root[a[front]] = node[a[s]]
            hit = links > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[hit]), pa.array(links[hit]), pa.array(root[hit])], ["node", "links", "root"]
                )

    return run


def near_duplicates(
    vectors: DataFrame, cfg: CosineConfig = CosineConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors`.

    Two rows are linked when their labels are equal and the cosine in double precision
    reaches the threshold and the cells bring them together (see above; `spread` None
    finds all).  Defined cases: a vector that is null, empty, zero or holds a
    null or non-finite component, and a row with a null label or vec_id, links with
    nothing; vectors of different lengths aren't linked; rows that repeat a vec_id count
    as vectors of their own; equal vectors of one label are linked with each other, and of
    rows that tie for the smallest vec_id each is kept; a null vec_id has a null component_id
    and is kept; an empty table gives an empty result; other columns, whatever their names,
    are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    raw = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
    )
    rows = work.save(raw.mapInArrow(_clean(cfg), "vec_id long, label long, vector binary"), "rows")
    merged = (
        rows.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    )
    for salt in range(cfg.seed, cfg.seed + 8):  # a number of its own for each class: with another salt where two share one
        node = F.xxhash64(F.lit(salt), "label", "vector")
        classes = work.save(merged.withColumn("node", node), "classes")
        if classes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("two classes share a hash under every salt")
    sizes = classes.groupBy(F.octet_length("vector").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row per vector length
    centroids = {}
    for dim, n in sizes:
        part = classes.where(F.octet_length("vector") == dim).orderBy(F.xxhash64("node", F.lit(cfg.seed)), "node").limit(cfg.sample)
        k = int(min(cfg.most_cells, max(1, n // cfg.cell_rows)))
        centroids[dim] = spherical_kmeans(_unit([r[0] for r in part.select("vector").collect()]), k, cfg.rounds, cfg.seed)
    placed = work.save(
        classes.select("label", "node", "copies", "vector").mapInArrow(
            _cells(centroids, cfg), "label long, dim int, cell int, visit boolean, node long, copies long, vector binary"
        ),
        "cells",
    )
    cell = ["label", "dim", "cell"]
    counts = placed.groupBy(*cell).agg(
        F.ceil(F.count_if(~F.col("visit")) / cfg.block).cast("int").alias("tall"),
        F.ceil(F.count_if(F.col("visit")) / cfg.block).cast("int").alias("wide"),
    )
    sized = placed.join(counts.where("tall > 0"), cell)
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
    at_home = sized.where("not visit").withColumn("p", part("tall"))
    visiting = sized.where("visit").withColumn("p", part("wide"))
    keep = [*_BLOCK, "line", "node", "copies", "vector"]
    # Lines: home part i against home part j > i, itself (j = i), and visiting part j (numbered from tall on).
    lines = at_home.withColumn("i", F.col("p")).withColumn("j", F.explode(F.sequence(F.col("p"), F.col("tall") + F.col("wide") - 1)))
    inner = at_home.where("p > 0").withColumn("j", F.col("p")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    outer = visiting.withColumn("j", F.col("tall") + F.col("p")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)))
    pick = lambda df, line: df.withColumn("line", F.lit(line)).select(*keep)
    blocks = pick(lines, True).unionByName(pick(inner, False)).unionByName(pick(outer, False))
    blocks = blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    found = work.save(blocks.mapInArrow(_blocks(cfg), "node long, links long, root long"), "links")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), work)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.select("node", "copies", "vec_id")
        .join(links, "node", "left")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = work.save(named, "named")
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    result = named.join(smallest, "component").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id"
    )
    full = rows.select("vec_id", F.when(F.col("vector").isNotNull(), node).alias("node")).join(result, "node", "left")
    return full.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
