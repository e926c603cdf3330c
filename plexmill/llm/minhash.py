"""MinHash near-dedup: universal hash minima, banding, verified links, components.

Rows with the same shingle set form one class, so copies cost one row each and
never meet in pairs.  Class signatures hold `bands * rows` minima.  Classes that
share a band bucket are candidates.  A bucket of any size is dealt with without
emitting its pairs:

* every member is first compared with one hub per bucket (a per-bucket random
  member), and the best-matching hub of each class is verified on full sets;
* only buckets that still hold several components go on; in these the members
  outside the bucket's main component are compared with all, in blocks of
  bounded size spread over tasks: signatures first, then full sets of those
  that come near.  A block returns a spanning forest of its links.  A sixth of the
  buckets goes first: what it joins leaves little open in the others.

So links between different texts that share a bucket are found whatever the
group's size, but for signatures that fall short of the similarity by `slack`
standard errors (a chance below 2e-6 at the threshold).  `bands` and `rows` set the chance of sharing no
bucket: for 24 bands of 6 rows it is 1.2e-5 at similarity 0.85.

A bucket of m classes, s of them outside its main component, costs s * m / 2
comparisons of signatures in blocks of bounded memory: time grows with the square
of a bucket of texts that share a band but are not alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .storage import Workspace


@dataclass(frozen=True)
class MinHashConfig:
    shingle: int = 5
    similarity_percent: int = 80
    bands: int = 32
    rows: int = 5
    seed: int = 1
    block: int = 256
    slack: float = 5.0  # standard errors a signature estimate may fall short by

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        s = self.similarity_percent / 100
        return s - self.slack * (s * (1 - s) / self.minima) ** 0.5


def _coefficients(cfg: MinHashConfig) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(cfg.seed))
    a = g.integers(1, 1 << 63, cfg.minima, dtype=np.uint64) | np.uint64(1)
    b = g.integers(0, 1 << 63, cfg.minima, dtype=np.uint64)
    return a, b


def _sets(batch: pa.RecordBatch, size: int):
    """(lo, hi, sizes, bounds, hashes, k1, k2) for row ranges of a batch."""
    for lo, hi, raw, offs in K.row_ranges(batch.column("text")):
        owner, h = K.shingles(K.words(K.lowered(raw), offs), size)
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        sizes = np.diff(bounds)
        k1 = np.zeros(hi - lo, np.uint64)
        k2 = np.zeros(hi - lo, np.uint64)
        has = sizes > 0
        if has.any():
            at = bounds[:-1][has]
            k1[has] = K.mix64(np.add.reduceat(K.mix64(h), at))
            k2[has] = K.mix64(np.bitwise_xor.reduceat(K.mix64(h + np.uint64(0x51)), at))
        yield lo, hi, sizes, bounds, h, k1, k2


#: Two hashes of a text, which tell rows of one doc_id apart.
_TEXT_KEY = ("h1", "h2")


def signatures(docs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """doc_id, h1, h2, n_shingles, node, check, sig: one row for each row of `docs` (doc_id, text).

    h1 and h2 are hashes of the text; node and check identify the shingle set (128 bits); sig holds the minima as
    little-endian unsigned 32-bit integers, empty for a document without words.
    """
    a, b = _coefficients(cfg)

    def run(it):
        for batch in it:
            for lo, hi, sizes, bounds, h, k1, k2 in _sets(batch, cfg.shingle):
                has = sizes > 0
                sig = np.zeros((hi - lo, cfg.minima), np.uint32)
                if has.any():
                    at = bounds[:-1][has]
                    step = np.empty(len(h), np.uint64)
                    low = np.empty((int(has.sum()), cfg.minima), np.uint64)
                    for i in range(cfg.minima):
                        np.multiply(h, a[i], out=step)
                        np.add(step, b[i], out=step)
                        low[:, i] = np.minimum.reduceat(step, at)
                    sig[has] = (low >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", *_TEXT_KEY)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array([r.tobytes() if x else b"" for r, x in zip(sig, has, strict=True)], pa.binary()),
                    ],
                    ["doc_id", *_TEXT_KEY, "n_shingles", "node", "check", "sig"],
                )

    return docs.select("doc_id", *_text_key("text"), "text").mapInArrow(
        run, "doc_id long, h1 long, h2 long, n_shingles long, node long, check long, sig binary"
    )


def _text_key(text: str | Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(11), text).alias("h2")]


def _band_rows(classes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    def run(it):
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, cfg.bands, cfg.rows)
            key = np.broadcast_to(np.arange(cfg.bands, dtype=np.uint64), (n, cfg.bands)).copy()
            for r in range(cfg.rows):
                key = K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r].astype(np.uint64))
            node = np.repeat(batch.column("node").to_numpy(), cfg.bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], ["bucket", "node"])

    return classes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _shortened(classes: DataFrame) -> DataFrame:
    """`classes` with short: the low byte of each minimum."""

    def run(it):
        for batch in it:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, -1)
                low = [r.tobytes() for r in sig.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary())], [*batch.schema.names, "short"])

    return classes.mapInArrow(run, "node long, check long, doc_id long, sig binary, short binary")


#: Bits of a filter of ids at most: 8 MB, whatever the number of ids.
_MOST_BITS = 1 << 26


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id (doc_id), 16 bits for each id as far as `_MOST_BITS` go; other ids may share a bit."""
    size = min(_MOST_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    parts = ids.select(F.floor(place / 32768).cast("int").alias("part"), (place % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((size >> 15, 4096), np.uint8)
    for r in parts.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _full_sets(docs: DataFrame, wanted: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(node, shingles) for the documents whose ids are in `wanted` (doc_id, node, check).

    A filter of ids of bounded size leaves out most other documents where they are read, so no texts are dealt out.
    """
    bits = _id_filter(wanted.select("doc_id"))

    def run(it):
        for batch in it:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for _, _, _, bounds, h, k1, k2 in _sets(batch, cfg.shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    ],
                    ["node", "check", "shingles"],
                )

    found = (
        docs.where("doc_id is not null")
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(bits))).alias("place"), "text")
        .mapInArrow(run, "node long, check long, shingles binary")
    )
    # Ids that share a bit, and a repeated doc_id, bring other texts along: the join keeps the wanted sets, once each.
    key = ["node", "check"]
    return found.join(wanted.select(*key), key, "left_semi").groupBy(*key).agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def _verify(pairs: DataFrame, sets: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    want = cfg.similarity_percent

    def run(it):
        for batch in it:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(100 * both >= want * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"]
            )

    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _hub_pairs(members: DataFrame, hubs: DataFrame, sigs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """For each class the hub that its signature matches best, if near enough."""

    def run(it):
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint32).reshape(n, -1)
            y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint32).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1))], ["a", "b", "near"]
            )

    pairs = members.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    scored = (
        pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(run, "a long, b long, near double")
        .where(F.col("near") >= cfg.floor)
    )
    return scored.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b"))


def _open_blocks(members: DataFrame, labels: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """bucket, i, j, node, component, line: blocks of the buckets that hold several components.

    In each such bucket the classes outside its main component (line) are set
    against all (not line).  A block holds about `cfg.block` of each side; a bucket
    of m classes of which s lie outside the main component takes (s / block) *
    (m / block) blocks.
    """
    tagged = members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    per = tagged.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = (
        per.groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
        .where("n > most")
        .select(
            "bucket",
            "main",
            F.ceil(F.col("n") / cfg.block).cast("int").alias("wide"),
            F.ceil((F.col("n") - F.col("most")) / cfg.block).cast("int").alias("tall"),
        )
    )
    rows = tagged.join(open_, "bucket").withColumn("minor", F.col("component") != F.col("main"))
    cell = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    columns = rows.withColumn("j", cell("wide", 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)))
    lines = rows.where("minor").withColumn("i", cell("tall", 2)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    pick = lambda df, side: df.select("bucket", "i", "j", "node", "component", F.lit(side).alias("line"))
    return pick(columns, False).unionByName(pick(lines, True))


_BLOCK = ["bucket", "i", "j"]


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)


def _flagged(placed: DataFrame, active: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The rows of `placed` that some signature across components comes near enough to.

    One byte of each minimum is compared; that can only raise the estimate.
    """

    def run(it):
        for t in K.sorted_groups(it, _BLOCK):
            line = t.column("line").to_numpy(zero_copy_only=False)
            comp = t.column("component").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(comp), -1)
            lines, cols = np.flatnonzero(line), np.flatnonzero(~line)
            hit = np.zeros(len(comp), bool)
            least = int(np.ceil(cfg.floor * cfg.minima))
            for r in lines:
                near = (np.count_nonzero(sig[cols] == sig[r], axis=1) >= least) & (comp[cols] != comp[r])
                if near.any():
                    hit[r] = True
                    hit[cols[near]] = True
            if hit.any():
                yield t.drop_columns("sig").filter(pa.array(hit))

    short = active.select("node", F.col("short").alias("sig"))
    return _in_blocks(placed.join(short, "node").select(*_BLOCK, "node", "component", "line", "sig")).mapInArrow(
        run, "bucket long, i int, j int, node long, component long, line boolean"
    )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set (sorted arrays)."""
    if len(left) * len(right) <= 16:
        out = np.zeros((len(left), len(right)), np.int64)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                out[i, j] = (y[at] == x).sum()
        return out
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)))

    def ones(sets, vocabulary):
        m = np.zeros((len(sets), len(vocabulary)), np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(vocabulary, x)
            at[at == len(vocabulary)] = 0
            m[i, at[vocabulary[at] == x]] = 1
        return m

    for at in range(0, len(shared), 1 << 11):  # some shingles at a time: the matrices stay small
        part = shared[at : at + (1 << 11)]
        out += ones(left, part) @ ones(right, part).T
    return np.rint(out).astype(np.int64)


def _block_links(flagged: DataFrame, sets: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Links (a, b) between components, verified on full sets inside each block.

    A block returns a spanning forest of its links, so never more rows than it has.
    """

    def run(it):
        for t in K.sorted_groups(it, _BLOCK):
            line = t.column("line").to_numpy(zero_copy_only=False)
            comp = t.column("component").to_numpy()
            full = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            lines, cols = np.flatnonzero(line), np.flatnonzero(~line)
            if not len(lines) or not len(cols):
                continue
            size = np.array([len(x) for x in full])
            both = _common([full[i] for i in lines], [full[i] for i in cols])
            union = size[lines][:, None] + size[cols][None, :] - both
            ok = (100 * both >= cfg.similarity_percent * union) & (comp[lines][:, None] != comp[cols][None, :])
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            out = []
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = find(comp[lines[i]]), find(comp[cols[j]])
                if x != y:
                    root[x] = y
                    out.append((comp[lines[i]], comp[cols[j]]))
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _in_blocks(flagged.join(sets, "node")).mapInArrow(run, "a long, b long")


def _merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """`labels` (node, component) after the components `joined` (node, component) have become one.

    A component that isn't in `labels` is a node of its own.
    """
    alone = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return labels.unionByName(alone).join(new, "component", "left").select("node", F.coalesce("_new", "component").alias("component"))


def _grouped(docs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """doc_id, h1, h2, n_shingles, group, component_id for each row of `docs` (doc_id long, text string).

    group is the same number for all rows of a component; null, as component_id is, for a
    row that can't be linked.
    """
    work = Workspace(docs.sparkSession, "minhash")
    sigs = work.save(signatures(docs, cfg), "signatures")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = work.save(
        sigs.where(linkable)
        .groupBy("node", "check", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")),
        "classes",
    )
    bands = _band_rows(classes, cfg)
    hubs = work.save(
        bands.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("hub"))
        .where("n > 1")
        .select("bucket", "hub"),
        "hubs",
    )
    members = work.save(bands.join(hubs.select("bucket"), "bucket", "left_semi"), "members")
    active = classes.join(members.select("node").distinct(), "node", "left_semi")
    active = work.save(_shortened(active.select("node", "check", "doc_id", "sig")), "active")
    sets = work.save(_full_sets(docs, active.select("doc_id", "node", "check"), cfg), "sets")

    links = work.save(
        _verify(_hub_pairs(members, hubs, active, cfg), sets, cfg).where("linked").select("a", "b"), "hub-links"
    )
    labels = work.save(connected_components(links, work), "labels")
    early = F.pmod(F.xxhash64("bucket"), F.lit(6)) == 0
    for part in (members.where(early), members.where(~early)):
        flagged = work.save(_flagged(_open_blocks(part, labels, cfg), active, cfg), "flagged")
        more = work.save(_block_links(flagged, sets, cfg), "block-links")
        if not more.isEmpty():
            labels = work.save(_merged(labels, connected_components(more, work)), "labels")
        work.drop(flagged)
        work.drop(more)
    for table in (members, hubs, active, sets, links):
        work.drop(table)
    named = classes.join(labels, "node", "left").select(
        "node", "check", F.coalesce("component", "node").alias("component"), "doc_id"
    )
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    multi = labels.select("component").distinct()
    # Only classes with links need their component's smallest id; the others have their own.
    linked = (
        named.join(multi, "component", "left_semi").join(smallest, "component").select("node", "check", "component_id")
    )
    out = work.save(
        named.join(linked, ["node", "check"], "left").select(
            "node", "check", "component", F.coalesce("component_id", "doc_id").alias("component_id")
        ),
        "classes-with-component",
    )
    full = sigs.select("doc_id", *_TEXT_KEY, "n_shingles", "node", "check").join(out, ["node", "check"], "left")
    own = lambda c: F.when(linkable, F.col(c))
    return full.select("doc_id", *_TEXT_KEY, "n_shingles", own("component").alias("group"), own("component_id").alias("component_id"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Words are runs of bytes other than space and \\t to \\r, A-Z lowered.  Two
    documents are linked when their shingle sets reach the similarity; component_id
    is the smallest doc_id reachable.  Defined cases: a null or wordless text has
    n_shingles 0 and links with nothing; a row with a null doc_id links with
    nothing, has a null component_id and is kept; rows that repeat a doc_id are
    returned as often as they occur; an empty table gives an empty result; other
    columns of `docs` are ignored; a long text is held whole, with some 40 bytes for
    each of its words, by the task that reads it.
    """
    found = _grouped(_texts(docs, id_col, text_col), cfg)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def keep_one_of_each_group(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """The rows of `docs`, all columns, that stay when each group of near copies keeps one.

    The row with the smallest doc_id stays; of rows of that id in the group, one.  Rows of
    one doc_id whose texts aren't near copies are in groups of their own, and stay.  Rows
    with a null doc_id and rows without a word are in no group, and stay.  An empty table
    gives an empty result; any other columns, whatever their names, stay as they are; long
    texts as in `near_duplicates`.
    """
    work = Workspace(docs.sparkSession, "keep")
    found = _grouped(_texts(docs, "doc_id", "text"), cfg).where("group is not null")
    key = ["doc_id", *_TEXT_KEY]
    # How often each row of a group occurs, and then the first row of each group.
    counted = found.groupBy("group", *key).agg(F.count("*").alias("n"))
    first = work.save(counted.groupBy("group").agg(F.min(F.struct(*key, "n")).alias("k")).select("k.*"), "kept")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *[h.alias(n) for h, n in zip(_text_key(F.col("text").cast("string")), _TEXT_KEY, strict=True)],
        F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("has_words"),
    )
    in_group = F.col("doc_id").isNotNull() & F.col("has_words")
    grouped = rows.where(in_group)
    single = grouped.join(first.where("n = 1"), key, "left_semi").select("row")
    repeated = grouped.join(first.where("n > 1"), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).unionByName(rows.where(~in_group).select("row")).select("row.*")
