"""Rules, scores and checks over symbols, references and package communications.

symbols: (id, name, kind, pkg, file, exported, receiver, ...); references: (id, src, dst,
state, kind, file, ...); comms: (src, tgt).  Rules give findings (rule, severity, target,
detail); see `rules`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import version as V
from . import graph as G
from .rounds import dealt, written
from .rules import finding

#: Fixed values.
DEPRECATED_KEYS = {
    "legacy_mode": "use feature_flags instead", "enable_v1": "v1 endpoints are deprecated", "deprecated_token": "migrate to oauth2 credentials",
}
MAINTAINABILITY_POINTS = {"large_file": 2.0, "large_function": 3.0, "duplicate_logic": 4.0, "tight_coupling": 4.0, "dead_code": 2.0}
#: Fixed values: (kind of edge, types it may come from, types it may lead to); none: any.
EDGE_TYPES = [
    ("contains", ["repository"], ["module", "package", "documentation", "configuration"]),
    ("contains", ["module"], ["package", "file", "documentation", "configuration"]),
    ("contains", ["package"], ["file", "documentation", "configuration"]),
    ("contains", ["file"], ["symbol", "documentation", "configuration"]),
    ("contains", ["symbol"], ["symbol"]),
    ("imports", ["file", "package"], ["package", "file"]),
    ("implements", ["symbol"], ["symbol"]),
    ("calls", ["symbol"], ["symbol"]),
    ("references", ["symbol", "file", "package"], ["symbol"]),
    ("depends_on", [], []),
    ("documents", ["documentation"], []),
    ("configures", ["configuration"], []),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _unused(symbols: DataFrame, references: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Symbols whose id and name no reference (and no call) leads to."""
    targets = references.select(F.col("dst").alias("_t"))
    if calls is not None:
        targets = targets.unionByName(calls.select(F.col("dst").alias("_t")))
    targets = targets.distinct()
    return symbols.join(targets, F.col("id") == F.col("_t"), "left_anti").join(targets, F.col("name") == F.col("_t"), "left_anti")


def dead_code(symbols: DataFrame, references: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols nothing leads to, but for main and init, tests, the public API of packages that aren't internal, and interfaces."""
    may = symbols.where(
        ~F.col("name").isin("main", "init")
        & ~F.col("file").endswith("_test.go")
        & ~(F.col("exported") & ~F.col("pkg").contains("internal"))
        & (F.col("kind") != "interface")
    )
    return finding(_unused(may, references, calls), "dead_code", "medium", F.col("id"), F.col("pkg"))


def unused_exports(symbols: DataFrame, references: DataFrame) -> DataFrame:
    may = symbols.where(F.col("exported") & F.col("pkg").contains("internal") & ~F.col("file").endswith("_test.go"))
    return finding(_unused(may, references), "unused_export", "low", F.col("id"), F.col("pkg"))


def unused_imports(imports: DataFrame, references: DataFrame) -> DataFrame:
    """Imports (file, target) that no reference (file, target) of their file holds as a part, but for those that begin with _.

    Every stretch of a reference's target that ends at a mark (/ . : ( or its end) and starts
    after one is a key, so the join is by equality; a target's stretches are few.
    """
    marks = r"[/.:(]"
    cut = F.split("target", rf"(?<={marks})|(?={marks})")
    n = F.size(cut)
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, n), lambda b: F.array_join(F.slice(cut, a, b - a + 1), "")))
    )
    used = references.select("file", F.explode(F.array_distinct(spans)).alias("target")).distinct()
    bad = imports.where(~F.col("target").startswith("_")).join(used, ["file", "target"], "left_anti")
    return finding(bad, "unused_import", "low", F.col("file"), F.col("target"))


def large_functions(symbols: DataFrame, signature: Column, doc: Column, most: int = 80) -> DataFrame:
    """Functions and methods whose signature has more than `most` lines, but for those marked @large_ok."""
    lines = F.length(signature) - F.length(F.replace(signature, F.lit("\n"), F.lit(""))) + 1
    bad = symbols.where(F.col("kind").isin("function", "method") & ~F.coalesce(doc, F.lit("")).contains("@large_ok") & (lines > most))
    return finding(bad, "large_function", "medium", F.col("id"), lines)


def invalid_imports(references: DataFrame) -> DataFrame:
    bad = references.where((F.col("state") == "broken") | (F.coalesce("dst", F.lit("")) == ""))
    return finding(bad, "invalid_import", "high", F.col("id"), F.col("state"))


def architecture_violations(comms: DataFrame) -> DataFrame:
    bad = comms.where((F.col("src").contains("platform") | F.col("src").contains("engine")) & F.col("tgt").contains("intelligence"))
    return finding(bad, "architecture_violation", "critical", F.col("src"), F.col("tgt"))


def module_boundaries(comms: DataFrame) -> DataFrame:
    """Uses of a package under an internal folder from another first segment."""
    a, b = X.first_segment(F.col("src")), X.first_segment(F.col("tgt"))
    private = F.col("tgt").contains("/internal/") | F.col("tgt").startswith("internal/")
    return finding(comms.where(private & (a != "") & (b != "") & (a != b)), "module_boundary", "high", F.col("src"), F.col("tgt"))


def layer_consistency(comms: DataFrame) -> DataFrame:
    bad = comms.where(F.col("src").startswith("cmd/") & F.col("tgt").contains("capabilities/intelligence/navigation"))
    return finding(bad, "layer_consistency", "low", F.col("src"), F.col("tgt"))


def repository_organization(files: DataFrame) -> DataFrame:
    """Go files other than main.go at the top of the repository, each once; files: (file)."""
    bad = files.select("file").distinct().where(~F.col("file").contains("/") & F.col("file").endswith(".go") & (F.col("file") != "main.go"))
    return finding(bad, "repository_organization", "info", F.col("file"), F.lit("root"))


def missing_configuration(builds: DataFrame) -> DataFrame:
    """One finding if there is no build or module configuration at all."""
    return finding(builds.agg(F.count("*").alias("n")).where("n = 0"), "missing_configuration", "medium", F.lit("repository"), F.lit("no build configuration"))


def deprecated_configuration(entries: DataFrame) -> DataFrame:
    key = F.lower("key")
    hint = None
    for k, v in DEPRECATED_KEYS.items():
        hint = F.when(key == k, v) if hint is None else hint.when(key == k, v)
    return finding(entries.where(key.isin(*DEPRECATED_KEYS)), "deprecated_configuration", "low", F.concat_ws("#", "file", "ordinal"), hint)


def maintainability(findings: DataFrame) -> DataFrame:
    """One row: 100 less the points of the findings, 0 to 100."""
    points = F.lit(0.0)
    for rule, n in MAINTAINABILITY_POINTS.items():
        points = F.when(F.col("rule") == rule, n).otherwise(points)
    total = F.coalesce(F.sum(points), F.lit(0.0))
    return findings.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total)).alias("score"))


def insights(packages: DataFrame, edges: DataFrame, symbols: DataFrame, density: int = 20, fan_out: int = 10, bridge: int = 15, fan_in: int = 8, share: float = 0.4) -> DataFrame:
    """(insight, id, n): dense packages, wide dependencies, busy bridges, packages with most symbols, and single points of failure.

    packages: (id); edges: (src, dst, kind) of any nodes; symbols: (id, pkg), counted if more than 20.
    """
    d = G.degrees(packages, edges)
    dep = G.degrees(packages, edges.where(F.col("kind").isin("depends_on", "imports")))
    ends = [packages.select(F.col("id").alias(c)) for c in ("src", "dst")]
    between = edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")
    bridges = between.groupBy(F.concat_ws("->", "src", "dst").alias("id")).agg(F.count("*").alias("n"))
    total = symbols.agg(F.count("*").alias("_all"))
    per = symbols.groupBy(F.col("pkg").alias("id")).agg(F.count("*").alias("n")).join(packages.select("id"), "id", "left_semi").join(F.broadcast(total))
    row = lambda df, name, n: df.select(F.lit(name).alias("insight"), "id", n.cast("long").alias("n"))
    both = F.col("in_degree") + F.col("out_degree")
    return _union(
        [
            row(d.where(both > density), "complexity", both),
            row(dep.where(F.col("out_degree") > fan_out), "dependency", F.col("out_degree")),
            row(bridges.where(F.col("n") > bridge), "architecture", F.col("n")),
            row(per.where((F.col("_all") > 20) & (F.col("n") / F.col("_all") > share)), "growth", F.col("n")),
            row(dep.where(F.col("in_degree") > fan_in), "risk", F.col("in_degree")),
        ]
    )


def recommendations(packages: DataFrame, edges: DataFrame, symbols: DataFrame, calls: DataFrame, documented: DataFrame, fan_out: int = 8, callers: int = 10, files: int = 30) -> DataFrame:
    """(rule, priority, id), each once: all eight rules.

    packages: (id); edges: (src, dst, kind) between packages; calls: (src, dst) between
    symbols; documented: (id) of symbols with a document.
    """
    dep = edges.where(F.col("kind").isin("depends_on", "imports"))
    pair = dep.select("src", "dst").distinct()
    back = pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    circular = pair.join(back, ["src", "dst"]).select(F.col("src").alias("id"))
    wide = dep.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= fan_out)
    orphan = G.orphans(packages, edges).where((F.col("id") != "cmd") & ~F.col("id").startswith("cmd/"))
    inverted = edges.where(F.col("kind").isin("calls", "depends_on") & F.col("src").contains("storage") & F.col("dst").contains("service")).select(F.col("src").alias("id"))
    hubs = calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).where(F.col("n") >= callers).join(dealt(symbols.select("id")), "id", "left_semi")
    large = symbols.where("pkg <> ''").groupBy(F.col("pkg").alias("id")).agg(F.countDistinct("file").alias("n")).where(F.col("n") >= files)
    api = symbols.where(F.col("name").rlike(r"^\p{Lu}") & ~F.col("file").endswith("_test.go"))
    undocumented = api.where("pkg <> ''").join(dealt(documented.select("id").distinct()), "id", "left_anti")
    uncalled = api.where((F.col("pkg") != "main") & ~F.col("pkg").startswith("cmd")).join(dealt(calls.select(F.col("dst").alias("id")).distinct()), "id", "left_anti")
    row = lambda df, rule, p: df.select(F.lit(rule).alias("rule"), F.lit(p).alias("priority"), "id").distinct()
    return _union(
        [
            row(circular, "break_cycle", "critical"), row(wide, "reduce_fan_out", "high"), row(orphan, "remove_orphan", "low"),
            row(inverted, "invert_layer", "high"), row(hubs, "relieve_hub", "medium"), row(large, "split_package", "medium"),
            row(undocumented, "document_api", "info"), row(uncalled, "unexport", "low"),
        ]
    )


def move_safety(symbols: DataFrame, calls: DataFrame, target: str) -> DataFrame:
    """(id, blocked, callers, callees, verdict) of moving each symbol to the package `target`.

    Blocked where the target already has a symbol of that name; unsafe where something else
    calls it from, or it calls something in, another package than the target.
    """
    there = symbols.where(F.col("pkg") == target).select("name").distinct().withColumn("_there", F.lit(True))
    p = symbols.select("id", "pkg")
    s, t = dealt(p.select(F.col("id").alias("src"), F.col("pkg").alias("_ps"))), dealt(p.select(F.col("id").alias("dst"), F.col("pkg").alias("_pt")))
    c = calls.join(s, "src").join(t, "dst")
    into = c.where(F.col("_ps") != target).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    out = c.where(F.col("_pt") != target).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))
    j = symbols.where(F.col("pkg") != target).select("id", "name").join(dealt(there), "name", "left").join(dealt(into), "id", "left").join(dealt(out), "id", "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    blocked = F.coalesce("_there", F.lit(False))
    verdict = F.when(blocked, "blocked").when((z("callers") > 0) | (z("callees") > 0), "unsafe").otherwise("safe")
    return j.select("id", blocked.alias("blocked"), z("callers").alias("callers"), z("callees").alias("callees"), verdict.alias("verdict"))


def validate_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(issue, id): broken references, resolved ones whose target isn't declared, and ids declared at several places."""
    known = symbols.select(F.col("id").alias("dst")).distinct()
    missing = references.where("state = 'resolved'").join(known, "dst", "left_anti")
    twice = symbols.groupBy("id").agg(F.countDistinct("file", "line").alias("n")).where("n > 1")
    row = lambda df, issue: df.select(F.lit(issue).alias("issue"), "id")
    return _union([row(references.where("state = 'broken'"), "broken_reference"), row(missing, "missing_symbol"), row(twice, "duplicate_symbol")])


def illegal_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (id) whose kind isn't allowed between the types of their ends, by the fixed matrix; unknown kinds aren't."""
    n = nodes.select("id", "type")
    s, t = n.select(F.col("id").alias("src"), F.col("type").alias("_s")), n.select(F.col("id").alias("dst"), F.col("type").alias("_t"))
    allowed = F.lit(False)
    for kind, of, to in EDGE_TYPES:
        fits = F.col("kind") == kind
        fits = fits & F.col("_s").isin(*of) if of else fits
        allowed = allowed | (fits & F.col("_t").isin(*to) if to else fits)
    return edges.join(s, "src").join(t, "dst").where(~allowed).select("id")


def _uses(references: DataFrame, calls: DataFrame) -> DataFrame:
    """(target, id) of references and calls.  Ids are names, or numbers that stand for them."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    r = references.where((dst != "") & (src != "") & (src != ".") & (F.col("src") != F.col("dst")))
    return r.select(F.col("dst").alias("target"), F.col("src").alias("id")).unionByName(calls.where("src <> dst").select(F.col("dst").alias("target"), F.col("src").alias("id")))


def impact_of_symbols(references: DataFrame, calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, symbol, how): what a change of each target (target) reaches: direct (references and calls), then transitive (calls)."""
    direct = _uses(references, calls).join(dealt(targets.select("target").distinct()), "target", "left_semi").distinct()
    direct = G.cut(direct)
    reached = _upward(calls, direct)
    return direct.select("target", F.col("id").alias("symbol"), F.lit("direct").alias("how")).unionByName(
        reached.select("target", F.col("id").alias("symbol"), F.lit("transitive").alias("how"))
    )


def _calling(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, up): callers, each once; (id): what is called; and (id, up): callers that are called themselves."""
    up = G.cut(calls.select(F.col("dst").alias("id"), F.col("src").alias("up")).where("id <> up").distinct())
    called = G.cut(up.select("id").distinct())
    return up, called, dealt(G.cut(up.join(dealt(called.select(F.col("id").alias("up"))), "up", "left_semi").select("id", "up")))


def _called(calls: DataFrame, direct: DataFrame, keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, up): callers, each once; and (target, id): what is reached and called itself, so that it has callers to reach.

    Rounds go over calls between symbols that are called themselves; most callers are called by nothing, and no round sees them.
    """
    up, called, inner = _calling(calls)
    seen = front = G.cut(direct.select("target", "id").join(dealt(called), "id", "left_semi").select("target", "id"))
    rounds = 0
    while True:
        step = front.join(inner, "id").select("target", F.col("up").alias("id"))
        step = (step if keys else step.where("target <> id")).distinct()
        front = G.cut(step.join(dealt(seen), ["target", "id"], "left_anti"))
        if front.isEmpty():
            return up, seen
        rounds += 1
        seen = G.cut(seen.unionByName(front)) if rounds % 16 == 0 else seen.unionByName(front)


def _upward(calls: DataFrame, direct: DataFrame, keys: bool = False) -> DataFrame:
    """(target, id): callers of callers of what is direct, without the target (with `keys` targets are no ids) and what is direct."""
    up, seen = _called(calls, direct, keys)
    step = seen.join(dealt(up), "id").select("target", F.col("up").alias("id"))
    step = (step if keys else step.where("target <> id")).distinct()
    return step.join(dealt(direct.select("target", "id")), ["target", "id"], "left_anti")


def _block_counts(block: pa.Table) -> pa.Table:
    """(target, n, first) of one block of `impact_counts`: a bit for each symbol and target, a few thousand symbols at a time."""
    x, word = block.column("x").to_numpy(), block.column("word").to_numpy()
    named = block.column("y").is_valid().to_numpy()
    y = block.column("y").fill_null(0).to_numpy()
    is_edge, is_bits, is_direct, is_target = word == -1, named & (word >= 0), ~named & (word >= 0), word < -1
    slots = -2 - word[is_target]
    target = np.empty(len(slots), np.int64)
    target[slots] = x[is_target]
    order = np.lexsort((y[is_edge], x[is_edge]))
    ex, (ys, at) = x[is_edge][order], np.unique(y[is_edge][order], return_inverse=True)
    reach = np.zeros((len(ys), -(-len(slots) // 64)), "<u8")
    reach[np.searchsorted(ys, y[is_bits]), word[is_bits]] = x[is_bits].view(np.uint64)
    xs, starts = np.unique(ex, return_index=True)
    # What is direct, or the target itself, isn't transitive.
    dx, ds = np.concatenate([x[is_direct], target]), np.concatenate([word[is_direct], np.arange(len(slots))])
    order = np.argsort(dx, kind="stable")
    dx, ds = dx[order], ds[order]
    n, first = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
    bounds = np.append(starts, len(ex))
    lo = 0
    while lo < len(xs):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 15), "right")) - 1)
        rows = np.bitwise_or.reduceat(reach[at[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], axis=0)
        a, b = np.searchsorted(dx, xs[lo]), np.searchsorted(dx, xs[hi - 1], "right")
        row = np.minimum(np.searchsorted(xs[lo:hi], dx[a:b]), hi - lo - 1)
        same = xs[lo:hi][row] == dx[a:b]
        slot = ds[a:b][same].astype(np.uint64)
        np.bitwise_and.at(rows, (row[same], slot >> np.uint64(6)), ~(np.uint64(1) << (slot & np.uint64(63))))
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, : len(slots)]
        more = bits.sum(axis=0, dtype=np.int64)
        fresh = (n == 0) & (more > 0)
        first[fresh] = xs[lo + bits[:, fresh].argmax(axis=0)]
        n += more
        lo = hi
    some = n > 0
    return pa.table({"target": target[some], "n": n[some], "first": first[some]})


#: Columns of 64 targets in a row of `_reached_bits`.
_WORDS = [f"w{k}" for k in range(8)]


def _or(df: DataFrame) -> DataFrame:
    """A row for each symbol, group and part, with the bits of all its rows."""
    return df.groupBy("id", "a", "part").agg(*(F.bit_or(w).alias(w) for w in _WORDS))


def _any(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda x, y: x | y, (F.col(w) != 0 for w in _WORDS)))


def _reached_bits(first: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, a, part, w0 to w7): the targets that reach each symbol that is called itself, by rounds over `inner` from what is direct.

    A target is a bit: a row holds 512 of them, so where many targets reach the same symbols, rounds deal out a row instead of 512.
    A round is written as a table, as it is joined with what was made of itself.
    """
    seen = front = written(_or(first))
    rounds = 0
    while True:
        step = _or(front.join(inner, "id").select(F.col("up").alias("id"), "a", "part", *_WORDS))
        old = _or(seen).withColumnsRenamed({w: f"_{w}" for w in _WORDS})
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in _WORDS]
        front = written(_any(step.join(dealt(old), ["id", "a", "part"], "left").select("id", "a", "part", *fresh)))
        if front.isEmpty():
            return _or(seen)
        rounds += 1
        seen = seen.unionByName(front)
        seen = written(_or(seen)) if rounds % 16 == 0 else seen


def impact_counts(references: DataFrame, calls: DataFrame, targets: DataFrame, wide: int = 2048, edges: int = 1_000_000) -> DataFrame:
    """(target, how, n, first): of the impact of each target (`impact_of_symbols`) how many symbols, and the least; ids are longs.

    A target is a bit, in rounds over what is called itself (`_reached_bits`) and where its callers are counted: in blocks of some
    `wide` targets and `edges` calls.  The work stays the product of targets and what reaches them, the rows that are dealt out don't.

    targets: (target) and, if known, (near): those that stand near each other by it are reached by much the same symbols, and share rows.
    """
    direct = G.cut(_uses(references, calls).join(dealt(targets.select("target").distinct()), "target", "left_semi").distinct())
    up, called, inner = _calling(calls)
    near = F.min("near" if "near" in targets.columns else "target").alias("near")
    some = targets.groupBy("target").agg(near).join(dealt(direct.select("target").distinct()), "target", "left_semi")
    # Ranges are of unequal size, so they are of three quarters of what a group holds, and cut where they are longer.
    groups, blocks = -(-max(1, some.count()) * 4 // (3 * wide)), -(-max(1, up.count()) // edges)
    ranges = G.cut(some.repartitionByRange(groups, "near", "target").select("target", "near", F.spark_partition_id().alias("_range")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("near", "target")) - 1
    slots = ranges.select("target", "_range", place.alias("_place"))
    slots = dealt(G.cut(slots.select("target", (F.col("_range") * groups + F.floor(F.col("_place") / wide)).cast("int").alias("a"), (F.col("_place") % wide).alias("slot"))))
    bit, n = F.expr("shiftleft(1L, slot % 64)"), len(_WORDS)
    word = [F.when(F.floor(F.col("slot") / 64) % n == k, bit).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(_WORDS)]
    part = F.floor(F.col("slot") / (64 * n)).cast("int").alias("part")
    reached = _reached_bits(direct.join(dealt(called), "id", "left_semi").join(slots, "target").select("id", "a", part, *word), inner)
    bits = reached.select("a", "id", "part", F.posexplode(F.array(*_WORDS)).alias("word", "bits")).where("bits <> 0")
    bits = written(bits.select("a", "id", (F.col("part") * n + F.col("word")).cast("int").alias("word"), "bits"))
    called = bits.select("a", "id").distinct()
    block = lambda x: (F.col("a") * blocks + F.pmod(F.xxhash64(x), F.lit(blocks))).cast("int").alias("block")
    calling = G.cut(dealt(up).join(called, "id").select("a", block("up"), F.col("up").alias("x"), F.col("id").alias("y")))
    none = F.lit(None).cast("long").alias("y")
    every = F.explode(F.sequence(F.col("a") * blocks, F.col("a") * blocks + (blocks - 1))).alias("block")
    rows = [
        calling.select("block", "x", "y", F.lit(-1).alias("word")),
        calling.select("a", "block", F.col("y").alias("id")).distinct().join(dealt(bits), ["a", "id"]).select("block", F.col("bits").alias("x"), F.col("id").alias("y"), "word"),
        direct.join(slots, "target").select(block("id"), F.col("id").alias("x"), none, F.col("slot").alias("word")),
        slots.select(every, F.col("target").alias("x"), none, (-2 - F.col("slot")).alias("word")),
    ]
    counted = _union(rows).groupBy("block").applyInArrow(_block_counts, "target long, n long, first long")
    transitive = counted.groupBy("target").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    row = lambda df, how: df.select("target", F.lit(how).alias("how"), "n", "first")
    return row(direct.groupBy("target").agg(F.count("*").alias("n"), F.min("id").alias("first")), "direct").unionByName(row(transitive, "transitive"))


def impact_of_keys(references: DataFrame, calls: DataFrame, targets: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """(key, symbols, packages): as `impact_by` of the impact of all targets, without listing it target by target.

    What the targets (target) of a file or package reach together is what any of them reaches, so a symbol is listed
    once for a key, however many targets of it reach the symbol.  An id of symbols stands once.
    """
    of = symbols.select(F.col("id").alias("target"), F.col(key).alias("key")).join(dealt(targets.select("target").distinct()), "target", "left_semi")
    direct = _uses(references, calls).join(dealt(of), "target").select(F.col("key").alias("target"), "id").where("target is not null").distinct()
    direct = G.cut(direct)
    reached = direct.unionByName(_upward(calls, direct, keys=True)).select(F.col("target").alias("key"), F.col("id").alias("symbol"))
    s = symbols.select(F.col("id").alias("symbol"), F.col(key).alias("_k"), F.col("pkg").alias("_p"))
    j = reached.join(dealt(s), "symbol").where("key <> _k")
    return j.groupBy("key").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("_p").alias("packages"))


def impact_by(impact: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """(key, symbols, packages): what a change of each file or package reaches outside of it; impact: (target, symbol)."""
    t = symbols.select(F.col("id").alias("target"), F.col(key).alias("key"))
    s = symbols.select(F.col("id").alias("symbol"), F.col(key).alias("_k"), F.col("pkg").alias("_p"))
    j = impact.join(t, "target").join(s, "symbol").where("key <> _k")
    return j.groupBy("key").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("_p").alias("packages"))


def dependency_impact(references: DataFrame, part: str) -> DataFrame:
    """(package, files): who refers to targets that hold `part`."""
    hit = references.where(F.col("dst").contains(part))
    return hit.groupBy(X.package_of_symbol(F.col("src")).alias("package")).agg(F.countDistinct("file").alias("files"))


def plan_checks(plugins: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, dependency, problem): missing mandatory dependencies, versions that don't fit, and ids given twice.  Of an id given twice the greatest version counts.

    plugins: (id, version); dependencies: (id, dependency, constraint, optional).
    """
    have = plugins.groupBy(F.col("id").alias("dependency")).agg(F.max_by("version", F.struct(V.parse(F.col("version")), F.col("version"))).alias("version"))
    j = dependencies.join(have, "dependency", "left")
    problem = F.when(F.col("version").isNull(), F.when(~F.col("optional"), "missing")).when(
        ~F.coalesce(V.satisfies(F.col("constraint"), V.parse(F.col("version"))), F.lit(False)), "incompatible"
    )
    twice = plugins.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return j.select("id", "dependency", problem.alias("problem")).where("problem is not null").unionByName(
        twice.select("id", F.lit(None).cast("string").alias("dependency"), F.lit("duplicate").alias("problem"))
    )


def best_versions(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, constraint, version): the greatest discoverable version that fits each constraint, null where none does.

    wanted: (id, constraint), an empty constraint holding for any; catalog: (id, version, discoverable).
    """
    w = wanted.distinct()
    fit = w.join(catalog.where("discoverable"), "id").where(V.satisfies(F.col("constraint"), V.parse(F.col("version"))))
    best = fit.groupBy("id", "constraint").agg(F.max_by("version", V.parse(F.col("version"))).alias("version"))
    return w.join(best, ["id", "constraint"], "left")


def conflicts(chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, constraint, version): constraints that the version chosen for their id doesn't meet."""
    j = wanted.distinct().join(chosen, "id")
    return j.where(~F.coalesce(V.satisfies(F.col("constraint"), V.parse(F.col("version"))), F.lit(False))).select("id", "constraint", "version")


def ordered(items: DataFrame, by: str = "relevance", descending: bool = True) -> list[Column]:
    """The total order of catalogue items for each way of sorting: score, downloads, rating, updated or name, then id."""
    way = lambda c: F.desc(c) if descending else F.asc(c)
    keys = {
        "downloads": [way("downloads")],
        "rating": [way("average_rating"), F.desc("rating_count")],
        "updated": [way("updated_at")],
        "name": [F.lower("name").desc() if descending else F.lower("name").asc()],
        "relevance": [way("relevance"), F.desc("downloads")],
    }
    return [*keys[by], F.asc("id")]
