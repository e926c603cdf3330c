"""Graph operators over nodes (id, ...) and edges (id, src, dst, kind, ...).

Traversals are rounds of joins between a frontier and the edges with an anti join
against what was visited.  The edges that a traversal may walk are computed once,
before its rounds, so no round scans what they come from again.  Path enumeration
extends all paths at once by an edge a round, up to a limit of nodes.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import longest_path, on_cycles
from .rounds import cut, dealt

MOST_DEPTH = 100
DEFAULT_DEPTH = 10


def _of_kinds(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges


def directed(edges: DataFrame, direction: str, kinds: Sequence[str] = ()) -> DataFrame:
    """(here, there, edge_id) for each way an edge may be walked: outbound, inbound or both."""
    e = _of_kinds(edges, kinds)
    out = e.select(F.col("src").alias("here"), F.col("dst").alias("there"), F.col("id").alias("edge_id"))
    into = e.select(F.col("dst").alias("here"), F.col("src").alias("there"), F.col("id").alias("edge_id"))
    return {"outbound": out, "inbound": into, "both": out.unionByName(into)}[direction]


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", kinds: Sequence[str] = (), loops: bool = False) -> DataFrame:
    """Distinct nodes one step away; the node itself only with `loops`."""
    near = directed(edges, direction, kinds).where(F.col("here") == node_id).select(F.col("there").alias("id")).distinct()
    if not loops:
        near = near.where(F.col("id") != node_id)
    return nodes.join(near, "id", "left_semi")


def bfs(edges: DataFrame, starts: DataFrame, direction: str = "outbound", max_depth: int = DEFAULT_DEPTH, kinds: Sequence[str] = ()) -> DataFrame:
    """(seed, id, depth): what each seed reaches, at its least depth.

    starts: (seed, id).  A negative depth means the default; above 100 is an error.
    """
    if max_depth > MOST_DEPTH:
        raise ValueError(f"depth {max_depth} is above {MOST_DEPTH}")
    steps = DEFAULT_DEPTH if max_depth < 0 else max_depth
    walk = cut(directed(edges, direction, kinds).select("here", "there").distinct())
    frontier = starts.select("seed", "id", F.lit(0).alias("depth")).distinct()
    visited = frontier
    for depth in range(1, steps + 1):
        step = (
            frontier.join(walk, F.col("id") == F.col("here"))
            .select("seed", F.col("there").alias("id"))
            .distinct()
            .join(visited.select("seed", "id"), ["seed", "id"], "left_anti")
        )
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def _one(spark, node_id: str) -> DataFrame:
    return spark.range(1).select(F.lit(node_id).alias("seed"), F.lit(node_id).alias("id"))


def traverse(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "outbound", max_depth: int = DEFAULT_DEPTH, kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges touched): edges that leave nodes at the greatest depth aren't touched."""
    steps = DEFAULT_DEPTH if max_depth < 0 else max_depth
    edges = cut(edges)
    reached = bfs(edges, _one(nodes.sparkSession, start), direction, steps, kinds).select("id", "depth")
    inner = reached.where(F.col("depth") < steps).select(F.col("id").alias("here"))
    touched = directed(edges, direction, kinds).join(inner, "here", "left_semi").select(F.col("edge_id").alias("id")).distinct()
    return nodes.join(reached, "id"), edges.join(touched, "id", "left_semi")


def ego_graph(nodes: DataFrame, edges: DataFrame, root: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhood of `root`, and all edges touched from inside the radius."""
    return traverse(nodes, edges, root, "both", radius)


def _extended(first: DataFrame, step, rounds: int):
    """The frames of each round: `first`, and what `step` makes of the one before, until one is empty."""
    frontier = cut(first)
    for n in range(rounds):
        if frontier.isEmpty():
            return
        yield frontier
        if n < rounds - 1:
            frontier = cut(step(frontier))


def _all(parts, schema: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, schema.limit(0))


def simple_paths(edges: DataFrame, start: str, end: str | None, max_nodes: int, kinds: Sequence[str] = ()) -> DataFrame:
    """(path, rels, hops): simple paths from start, of at most `max_nodes` nodes.

    Parallel edges give paths of their own.  With `end`, only paths that end there, and
    none if it is the start; else every path of one edge or more.  With `end`, only edges
    from which it can still be reached in time are walked.
    """
    e = cut(_of_kinds(edges, kinds).select("id", "src", "dst"))
    if end is not None:
        left = bfs(e.withColumn("kind", F.lit("")), _one(edges.sparkSession, end), "inbound", min(MOST_DEPTH, max_nodes))
        e = cut(e.join(left.select(F.col("id").alias("dst"), F.col("depth").alias("left")), "dst"))
        e = e.where(F.col("src") != end)
    else:
        e = e.withColumn("left", F.lit(0))

    def step(p: DataFrame) -> DataFrame:
        j = p.join(e, p["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")) & (F.size("path") + 1 + F.col("left") <= max_nodes))
        return j.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("rels", F.col("id")).alias("rels"))

    none = F.array().cast("array<string>")
    first = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), none.alias("rels"))
    found = _all(list(_extended(first, step, max_nodes))[1:], first)
    if end is not None:
        found = found.where(F.col("node") == end)
    return found.select("path", "rels", F.size("rels").alias("hops"))


def cycles(edges: DataFrame, max_nodes: int, kinds: Sequence[str] = ()) -> DataFrame:
    """(cycle, length): elementary cycles of at most `max_nodes` nodes, each from its smallest node."""
    e = cut(_of_kinds(edges, kinds).select("src", "dst").distinct())
    first = e.where("dst >= src").select(F.col("src").alias("first"), F.col("dst").alias("node"), F.array("src").alias("path"))

    def step(p: DataFrame) -> DataFrame:
        j = p.where("node <> first").join(e, p["node"] == e["src"]).where((F.col("dst") >= F.col("first")) & ~F.array_contains("path", F.col("node")))
        return j.select("first", F.col("dst").alias("node"), F.array_append("path", F.col("node")).alias("path"))

    found = _all(_extended(first, step, max_nodes), first)
    return found.where("node = first").select(F.col("path").alias("cycle"), F.size("path").alias("length"))


def dependency_chains(edges: DataFrame, max_edges: int, kinds: Sequence[str]) -> DataFrame:
    """(start, path, hops): every simple dependency path of at most `max_edges` edges, once each."""
    e = cut(_of_kinds(edges, kinds).select("src", "dst").where("src <> dst").distinct())
    first = e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))

    def step(p: DataFrame) -> DataFrame:
        j = p.join(e, p["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        return j.select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))

    found = _all(_extended(first, step, max_edges), first)
    return found.select("start", "path", (F.size("path") - 1).alias("hops"))


def call_depth(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """One row: edges of the longest simple path from `start`, at most `max_depth`; see `components.longest_path`."""
    return longest_path(edges, start, max_depth)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) for every node."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(dealt(into), "id", "left").join(dealt(out), "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, callers, callees): sorted distinct ends."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("callees"))
    none = F.array().cast("array<string>")
    return into.join(out, "id", "full_outer").select(
        "id", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees")
    )


def _depths(edges: DataFrame, starts: DataFrame, direction: str, kinds: Sequence[str]) -> DataFrame:
    """(seed, id, depth): everything reached, in as many rounds as it takes; each round visits something new."""
    walk = dealt(cut(directed(edges, direction, kinds).select("here", "there").distinct()))
    frontier = cut(starts.select("seed", "id").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while True:
        depth += 1
        frontier = cut(
            frontier.join(walk, F.col("id") == F.col("here"))
            .select("seed", F.col("there").alias("id"))
            .distinct()
            .join(dealt(visited), ["seed", "id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            return visited
        visited = cut(visited.unionByName(frontier)) if depth % 16 == 0 else visited.unionByName(frontier)


def reach(edges: DataFrame, starts: DataFrame, direction: str = "outbound", kinds: Sequence[str] = ()) -> DataFrame:
    """(seed, id): everything reached, the seeds left out, in as many rounds as it takes."""
    return _depths(edges, starts, direction, kinds).where(F.col("seed") != F.col("id")).select("seed", "id")


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, state): entry (no caller, with callees), reachable from an entry, or dead."""
    d = degrees(nodes, edges.where("src <> dst"))
    entries = d.where("in_degree = 0 and out_degree > 0").select(F.lit("all").alias("seed"), "id")
    reached = reach(edges, entries).select("id").withColumn("reached", F.lit(True))
    return d.join(reached, "id", "left").select(
        "id",
        F.when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), "entry")
        .when(F.col("reached"), "reachable")
        .otherwise("dead")
        .alias("state"),
    )


def max_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the greatest depth from nodes without inbound edges, or from the first node."""
    roots = degrees(nodes, edges).where("in_degree = 0").select(F.col("id").alias("seed"), "id")
    if roots.isEmpty():
        roots = nodes.orderBy("id").limit(1).select(F.col("id").alias("seed"), "id")
    return _depths(edges, roots, "outbound", ()).agg(F.max("depth").alias("max_depth"))


def ownership(edges: DataFrame, kind: str = "belongs_to") -> DataFrame:
    """(id, root, chain): each node's owners up to the root, by the first edge (least id) of the kind."""
    parent = (
        edges.where(F.col("kind") == kind)
        .groupBy(F.col("src").alias("child"))
        .agg(F.min_by("dst", "id").alias("parent"))
    )
    cur = parent.select(F.col("child").alias("id"), F.array("child", "parent").alias("chain"), F.col("parent").alias("root"))
    while True:
        joined = cur.join(parent, (F.col("root") == F.col("child")) & ~F.array_contains("chain", F.col("parent")), "left")
        grown = cut(
            joined.select(
                "id",
                F.when(F.col("parent").isNotNull(), F.array_append("chain", F.col("parent"))).otherwise(F.col("chain")).alias("chain"),
                F.coalesce("parent", "root").alias("root"),
                F.col("parent").isNotNull().alias("grew"),
            )
        )
        cur = grown.drop("grew")
        if grown.where("grew").isEmpty():
            return cur


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): dependencies (dst) before dependents (src); nodes on cycles have level null."""
    left = nodes.select("id").distinct()
    deps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    loops = cut(edges.where("src = dst").select(F.col("src").alias("id")).distinct())
    done = None
    for level in itertools.count():
        blocked = deps.join(dealt(left.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id"))
        blocked = dealt(blocked.unionByName(loops).distinct())
        ready = cut(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(dealt(ready), "id", "left_anti"))
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)


def merge_edges(edges: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Edges by id, provenance arrays united; other columns are those of the last row by `order`, then by themselves."""
    rest = [c for c in edges.columns if c not in ("id", "provenance")]
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("provenance"))))).alias("provenance")
    if not rest:
        return edges.groupBy("id").agg(united)
    last = F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_last")
    return edges.groupBy("id").agg(last, united).select("id", *[F.col(f"_last.{c}").alias(c) for c in rest], "provenance")


def first_by_id(df: DataFrame, *order: Column) -> DataFrame:
    """One row for each id, the first in the order given."""
    return df.groupBy("id").agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def validate(nodes: DataFrame, edges: DataFrame, allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(code, id): missing ends, kinds not allowed between node types, repeated ids, orphans."""
    spark = nodes.sparkSession
    types = nodes.select("id", "type")
    has = types.select("id").distinct()
    missing = [
        edges.join(has.select(F.col("id").alias(end)), end, "left_anti").select(F.lit(f"missing_{end}").alias("code"), "id")
        for end in ("src", "dst")
    ]
    dim = spark.createDataFrame(list(allowed), "kind string, src_type string, dst_type string")
    typed = edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(
        types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst"
    )
    illegal = typed.join(F.broadcast(dim), ["kind", "src_type", "dst_type"], "left_anti").select(F.lit("illegal_edge").alias("code"), "id")
    twice = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate_node").alias("code"), "id")
    alone = orphans(nodes, edges).select(F.lit("orphan").alias("code"), "id")
    out = missing[0]
    for part in (missing[1], illegal, twice, alone):
        out = out.unionByName(part)
    return out


def impact(nodes: DataFrame, edges: DataFrame, target: str, max_depth: int = 10) -> DataFrame:
    """(id, depth, path): what a change of `target` touches.

    Inbound edges except documents and configures, and outbound calls, depends_on and
    imports are followed; each node keeps one shortest path, by the smallest parent path.
    """
    skip = ["documents", "configures"]
    follow = ["calls", "depends_on", "imports"]
    walk = (
        edges.where(~F.col("kind").isin(skip))
        .select(F.col("dst").alias("here"), F.col("src").alias("there"))
        .unionByName(edges.where(F.col("kind").isin(follow)).select(F.col("src").alias("here"), F.col("dst").alias("there")))
        .distinct()
    )
    walk = cut(walk)
    frontier = nodes.sparkSession.range(1).select(
        F.lit(target).alias("id"), F.lit(0).alias("depth"), F.array(F.lit(target)).alias("path")
    )
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(walk, F.col("id") == F.col("here")).select(
            F.col("there").alias("id"), F.array_append("path", F.col("there")).alias("path")
        )
        step = step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        frontier = cut(step.select("id", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact_scope(affected: DataFrame, target_package: str) -> DataFrame:
    """One row (symbols, packages, cross_module, scope) of affected entities (id, type, pkg).

    Nothing affected is local; several packages or another package than the target's is module, and
    repository from 5 packages or 20 symbols on; one package is package; else local.
    """
    symbol, package = F.col("type") == "symbol", F.col("type") == "package"
    other = (F.col("pkg") != "") & F.lit(target_package != "") & (F.col("pkg") != target_package)
    n = affected.agg(
        F.countDistinct(F.when(symbol, F.col("id"))).alias("symbols"), F.countDistinct(F.when(package, F.col("id"))).alias("packages"),
        F.coalesce(F.bool_or(other), F.lit(False)).alias("cross_module"), F.count("*").alias("_n"),
    )
    wide = (F.col("packages") > 1) | F.col("cross_module")
    large = (F.col("packages") >= 5) | (F.col("symbols") >= 20)
    scope = F.when(F.col("_n") == 0, "local").when(wide & large, "repository").when(wide, "module").when(F.col("packages") == 1, "package").otherwise("local")
    return n.select("symbols", "packages", "cross_module", scope.alias("scope"))


def function_roles(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, entry, leaf, recursion, reach) of functions (id) and whatever calls (src, dst) name.

    Entries are main and init; leaves call nothing; recursion is direct, mutual or none; reach is
    confirmed from an entry, unreachable without a caller if not exported or at the top, else
    unknown; without any entry all is unknown.
    """
    c = cut(calls.select("src", "dst").distinct())
    ids = functions.select("id").unionByName(c.select(F.col("src").alias("id"))).unionByName(c.select(F.col("dst").alias("id"))).distinct()
    entry = F.col("id").endswith("main.main") | F.col("id").endswith(".init") | F.col("id").isin("main", "init")
    ids = cut(ids.withColumn("entry", entry))
    has = lambda end, name: c.select(F.col(end).alias("id")).distinct().withColumn(name, F.lit(True))
    direct = c.where("src = dst").select(F.col("src").alias("id")).withColumn("_direct", F.lit(True))
    mutual = on_cycles(c).withColumn("_mutual", F.lit(True))
    starts = ids.where("entry").select(F.lit("all").alias("seed"), "id")
    edges = c.select("src", "dst", F.lit("calls").alias("kind"), F.concat_ws("->", "src", "dst").alias("id"))
    reached = _depths(edges, starts, "outbound", ()).select("id").withColumn("_reached", F.lit(True))
    j = ids.join(has("src", "_out"), "id", "left").join(has("dst", "_in"), "id", "left").join(direct, "id", "left").join(mutual, "id", "left").join(reached, "id", "left")
    exported = F.substring_index("id", ".", -1).rlike("^[A-Z]")
    plain = ~exported | F.col("id").startswith("main.") | ~F.col("id").contains("/")
    reach_ = F.when(F.lit(starts.isEmpty()), "unknown").when(F.col("_reached"), "confirmed").when(F.col("_in").isNull() & plain, "unreachable").otherwise("unknown")
    return j.select(
        "id", "entry", F.col("_out").isNull().alias("leaf"),
        F.when(F.col("_mutual"), "mutual").when(F.col("_direct"), "direct").otherwise("none").alias("recursion"), reach_.alias("reach"),
    )
