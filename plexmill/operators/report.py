"""Listings, profiles, contexts and checks that put several relations together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as X
from ..functions import version as V
from . import graph as G
from .lookup import match_order, page

DEFAULT_TRAVERSE_DEPTH = 3


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def packages_page(symbols: DataFrame, pattern: str = "", module: str = "", offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of packages (package, symbols) whose path holds the pattern, in any case, under a module's prefix."""
    got = symbols.where(F.lower("pkg").contains(pattern.lower()) & F.col("pkg").startswith(module))
    return page(got.groupBy(F.col("pkg").alias("package")).agg(F.count("*").alias("symbols")), [F.col("package")], offset, limit)


def lookup_symbol(symbols: DataFrame, text: str, top: int = 10) -> DataFrame:
    """The symbol with that id; else the best of the first `top` search hits whose name is the text, in any case."""
    clean = text.strip()
    exact = symbols.where(F.col("id") == clean)
    hits = match_order(symbols, clean).limit(top).where(F.lower("name") == clean.lower())
    both = exact.select("id", "name", F.lit(0).alias("_rank"), F.lit(0.0).alias("_score")).unionByName(
        hits.select("id", "name", F.lit(1).alias("_rank"), (-F.col("score")).alias("_score"))
    )
    return both.orderBy("_rank", "_score", "id").limit(1).select("id", "name")


def entity_filter(types: list[str] | None = None, package: str = "") -> Column:
    """A predicate over entities (type, pkg): one of the types, in any case, and under the package's prefix."""
    fits = F.lower("type").isin(*[t.lower() for t in types]) if types else F.lit(True)
    return fits & F.col("pkg").startswith(package)


def traverse_nodes(nodes: DataFrame, edges: DataFrame, start: str, where: Column, max_depth: int = DEFAULT_TRAVERSE_DEPTH, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Nodes reached outwards, with depth; the predicate holds for what is returned, not for what is walked through."""
    reached, _ = G.traverse(nodes, edges, start, "outbound", max_depth, kinds)
    return reached.where(where)


def profile(files: DataFrame) -> DataFrame:
    """One row: files, directories, bytes and languages of files (path, size, language)."""
    return files.agg(
        F.count("*").alias("files"), F.countDistinct(X.dir_name(F.col("path"))).alias("directories"), F.sum("size").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def statistics(files: DataFrame, **groups: Column) -> DataFrame:
    """(statistic, key, n): how many files each value of each grouping has."""
    parts = [files.groupBy(c.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "key", "n") for name, c in groups.items()]
    return _union(parts).where("key is not null")


def structure(files: DataFrame) -> DataFrame:
    """(directory, files, modules, builds, configs, docs, vendored) of every directory of files (path)."""
    p = F.col("path")
    n = lambda c: F.count(c)
    return files.groupBy(X.dir_name(p).alias("directory")).agg(
        F.count("*").alias("files"), n(C.module_kind(p)).alias("modules"), n(C.build_system(p)).alias("builds"), n(C.config_kind(p)).alias("configs"),
        n(C.doc_kind(p)).alias("docs"), F.count_if(C.is_vendored(p)).alias("vendored"),
    )


def module_context(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(module, files, symbols, outgoing, incoming): of each first segment, and the references that cross its border."""
    own = symbols.groupBy(X.first_segment(F.col("pkg")).alias("module")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("symbols"))
    a, b = X.first_segment(F.col("src_pkg")), X.first_segment(F.col("dst_pkg"))
    across = references.where((F.col("dst") != "") & (a != b)).select(a.alias("_a"), b.alias("_b"))
    out = across.groupBy(F.col("_a").alias("module")).agg(F.count("*").alias("outgoing"))
    into = across.groupBy(F.col("_b").alias("module")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(out, "module", "left").join(into, "module", "left").select("module", "files", "symbols", zero("outgoing"), zero("incoming"))


def graph_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by type and edges by kind."""
    a = nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return a.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def dependency_edges(edges: DataFrame, part: str) -> DataFrame:
    """depends_on and imports edges with the part, in any case, in either end."""
    low = part.lower()
    return edges.where(F.col("kind").isin("depends_on", "imports") & (F.lower("src").contains(low) | F.lower("dst").contains(low)))


def dependencies_named(declared: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(name, source): declared dependencies of that name, in any case; if there is none, the ends of depends_on edges into it."""
    low = name.lower()
    own = declared.where(F.lower("name") == low).select("name", F.lit("declared").alias("source")).distinct()
    none = own.agg((F.count("*") == 0).alias("_none"))  # one row
    other = edges.where((F.col("kind") == "depends_on") & (F.lower("dst") == low)).select(F.col("src").alias("name"), F.lit("edge").alias("source")).distinct()
    return own.unionByName(other.join(F.broadcast(none)).where("_none").drop("_none"))


def calls_around(nodes: DataFrame, calls: DataFrame, text: str) -> DataFrame:
    """(direction, other) calls into and out of the entity with that id, else of the first one of that name."""
    hit = nodes.where((F.col("id") == text) | (F.col("name") == text))
    one = hit.agg(F.min(F.struct((F.col("id") != text).alias("_named"), "id")).alias("_h")).select(F.col("_h.id").alias("here"))
    into = calls.join(F.broadcast(one), F.col("dst") == F.col("here")).select(F.lit("in").alias("direction"), F.col("src").alias("other"))
    return into.unionByName(calls.join(F.broadcast(one), F.col("src") == F.col("here")).select(F.lit("out").alias("direction"), F.col("dst").alias("other")))


def validate_semantics(symbols: DataFrame, uses: DataFrame, implements: DataFrame) -> DataFrame:
    """(issue, id): names declared twice in a package, unresolved uses, private symbols used from another package,
    and implementing types that aren't declared.

    symbols: (id, name, pkg, exported); uses: (id, dst, src_pkg); implements: (interface_id, type_id).
    """
    twice = symbols.groupBy("pkg", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(".", "pkg", "name").alias("id"))
    t = symbols.select(F.col("id").alias("dst"), F.col("pkg").alias("_pkg"), F.col("exported").alias("_exported"))
    j = uses.join(t, "dst", "left")
    undeclared = implements.join(symbols.select(F.col("id").alias("type_id")), "type_id", "left_anti").select(F.col("type_id").alias("id")).distinct()
    row = lambda df, issue: df.select(F.lit(issue).alias("issue"), "id")
    return _union(
        [
            row(twice, "duplicate_definition"), row(j.where("_pkg is null"), "unresolved_reference"),
            row(j.where("_pkg <> src_pkg and not _exported"), "visibility_violation"), row(undeclared, "undeclared_implementor"),
        ]
    )


def validate_workspace(edges: DataFrame, files: DataFrame, shared: DataFrame, repositories: DataFrame) -> DataFrame:
    """(issue, id): cross-file dependencies (src, dst) on unknown files, shared dependencies (dependency, consumer, version)
    with several versions, and consumers that aren't known repositories (name)."""
    missing = edges.join(files.select(F.col("file").alias("dst")).distinct(), "dst", "left_anti").select(F.concat_ws("->", "src", "dst").alias("id"))
    several = shared.groupBy("dependency").agg(F.countDistinct("version").alias("n")).where("n > 1").select(F.col("dependency").alias("id"))
    unknown = shared.join(repositories.select(F.col("name").alias("consumer")).distinct(), "consumer", "left_anti").select(F.col("consumer").alias("id")).distinct()
    row = lambda df, issue: df.select(F.lit(issue).alias("issue"), "id")
    return _union([row(missing, "missing_target"), row(several, "incompatible_versions"), row(unknown, "unknown_repository")])


def validate_navigation(definitions: DataFrame, references: DataFrame, usages: DataFrame) -> DataFrame:
    """(issue, id): definitions without or with several targets, broken references, and usages recorded twice.

    definitions: (request, state); references: (id, dst, state); usages: (symbol, source, place).
    """
    row = lambda df, issue, i: df.select(F.lit(issue).alias("issue"), F.col(i).alias("id"))
    again = usages.groupBy("symbol", "source", "place").agg(F.count("*").alias("n")).where("n > 1").withColumn("id", F.concat_ws("<-", "symbol", "source", "place"))
    return _union(
        [
            row(definitions.where("state = 'not_found'"), "missing_target", "request"),
            row(definitions.where("state = 'ambiguous'"), "ambiguous_target", "request"),
            row(references.where("state = 'broken' or dst = ''"), "broken_reference", "id"),
            row(again, "duplicate_usage", "id"),
        ]
    )


def shared_dependencies(uses: DataFrame, repositories: DataFrame) -> DataFrame:
    """(dependency, repositories, packages): dependencies that several repositories use.

    uses: (pkg, dependency); repositories: (pkg, repository); a repository's use of itself doesn't count.
    """
    j = uses.join(repositories, "pkg").where("dependency <> repository")
    per = j.groupBy("dependency").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("pkg").alias("packages"))
    return per.where("repositories > 1")


def crash_counts(events: DataFrame, plugin: str, order: list[str], crash: Column) -> DataFrame:
    """(plugin, crashes): crashes of each plugin, but for one that is the first event seen of it."""
    seen = events.select(plugin, *order, crash.alias("_crash")).groupBy(plugin).agg(
        F.count_if("_crash").alias("_n"), F.min_by("_crash", F.struct(*order)).alias("_first")
    )
    return seen.select(F.col(plugin).alias("plugin"), (F.col("_n") - F.col("_first").cast("int")).alias("crashes"))


def reasoning(symbols: DataFrame, removal: DataFrame, findings: DataFrame, recommended: DataFrame) -> DataFrame:
    """(id, classification, findings, recommendations) of each symbol: what its removal breaks and what was found of it."""
    f = findings.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("findings"))
    r = recommended.groupBy("id").agg(F.count("*").alias("recommendations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return symbols.select("id").join(removal.select("id", "classification"), "id", "left").join(f, "id", "left").join(r, "id", "left").select(
        "id", "classification", zero("findings"), zero("recommendations")
    )


def newest(catalog: DataFrame) -> DataFrame:
    """(id, version) of each id's greatest version."""
    return catalog.groupBy("id").agg(F.max_by("version", V.parse(F.col("version"))).alias("version"))
