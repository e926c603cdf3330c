"""Sharding as a two-pass external shuffle.

Pass one scatters records uniformly: a seeded consistent hash of (doc_id, number
of shards) names the shard, and a second seeded hash names one of the shard's
memory-sized buckets, which are as many as the shard's bytes and rows call for.
Pass two reads one bucket at a time, puts it in a fixed order, applies a
Fisher-Yates shuffle seeded by the bucket's number and writes it.  A record's
position is its bucket's first slot plus its place there.

The shard depends on doc_id and the seed alone.  The bucket also depends on where
the record stands in the input, so that rows which repeat one doc_id and text are
dealt to all buckets of their shard.  An input that isn't a plain scan of files is
written first, so that a task run again after a lost executor deals as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Workspace, rereadable


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 24
    seed: int = 20
    bucket_mb: int = 16  # aimed at
    bucket_rows: int = 100_000  # aimed at
    most_partitions: int = 20_000  # beyond as many buckets a task takes several, one after the other


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard in 0 .. shards - 1 by highest random weight.

    Each shard draws a seeded weight for the key and the largest wins; a further
    shard wins only what it draws the largest weight for and moves nothing else.
    """
    draws = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("w"), F.lit(i).alias("s")) for i in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["s"]


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """An order of n rows, every one as likely: each place gets one of the rows not yet placed."""
    order = np.arange(n)
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    picks = draw.integers(0, np.arange(n, 0, -1))
    for i, p in enumerate(picks.tolist()):
        order[i], order[i + p] = order[i + p], order[i]
    return order


def _shuffle(cfg: ShardConfig):
    """Fisher-Yates over each bucket of a task's rows, which come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.sorted_groups(batches, ["bucket"]):
            order = fisher_yates(rows.num_rows, cfg.seed, rows.column("bucket")[0].as_py())
            # Written some rows at a time; the bucket itself is held once.
            for lo in range(0, rows.num_rows, 4096):
                part = rows.take(pa.array(order[lo : lo + 4096]))
                place = pa.array(np.arange(lo, lo + part.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, place], [*part.schema.names, "place"])

    return run


@dataclass(frozen=True)
class Shards:
    """records: the written rows with shard, bucket, place (and grown_shard);
    manifest: shard, bucket, rows, bytes, first_slot."""

    records: DataFrame
    manifest: DataFrame

    def slotted(self) -> DataFrame:
        return self.records.join(self.manifest.select("bucket", "first_slot"), "bucket").withColumn(
            "slot", F.col("first_slot") + F.col("place")
        )


def shard(docs: DataFrame, cfg: ShardConfig = ShardConfig(), id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Write `docs` (id and text) as shuffled shards and return them with a manifest.

    Defined cases: a null doc_id is a key of its own; null texts stay null and
    count 0 bytes plus 8; rows that repeat a doc_id share its shard and have slots
    of their own; an empty table gives no bucket; other columns are not written; a
    bucket holds a very long text whole.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not rereadable(rows):
        rows = work.save(rows, "input")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    shard_col = shard_of(F.col("doc_id"), cfg.shards, cfg.seed)
    totals = rows.groupBy(shard_col.alias("shard")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect()  # a row per shard
    per = [1] * cfg.shards
    for r in totals:
        per[r["shard"]] = max(1, -(-r.bytes // (cfg.bucket_mb << 20)), -(-r["rows"] // cfg.bucket_rows))
    before = [0, *np.cumsum(per).tolist()]
    of_shard = lambda values: F.get(F.array(*map(F.lit, values)), F.col("shard"))
    dealt = F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(cfg.seed + 1))
    placed = rows.select(
        "doc_id",
        "text",
        shard_col.alias("shard"),
        shard_of(F.col("doc_id"), cfg.shards + 1, cfg.seed).alias("grown_shard"),
        dealt.alias("dealt"),
    )
    bucket = (of_shard(before[:-1]) + F.pmod("dealt", of_shard(per))).cast("long")
    placed = placed.select("doc_id", "text", "shard", "grown_shard", bucket.alias("bucket"))
    partitions = min(before[-1], cfg.most_partitions)
    # Whole buckets to partitions by number: no two large ones meet by chance of a hash.
    scattered = placed.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int"))
    scattered = scattered.sortWithinPartitions("bucket", "doc_id", "text")
    written = work.save(
        scattered.mapInArrow(
            _shuffle(cfg), "doc_id long, text string, shard int, grown_shard int, bucket long, place long"
        ),
        "records",
    )
    per_bucket = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    manifest = per_bucket.withColumn("first_slot", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return Shards(written, work.save(manifest, "manifest"))


def digest(shards: Shards) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each written record."""
    return shards.slotted().select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
