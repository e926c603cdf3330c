"""Building the knowledge graph from extracted relations, and views of it by symbol, package and component."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .pointers import chase
from .rounds import cut, dealt

#: Names that resolve without a declaration.
BUILTIN_TYPES = [
    "bool", "byte", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune",
    "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "any",
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assemble(files: DataFrame, symbols: DataFrame, references: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files, packages and symbols.

    files: (path); symbols: (id, name, package_path, file_path); references: (source,
    target, kind); dependencies: (src, dst) between packages.  Edges whose ends aren't
    both nodes are left out; of repeated ids one stays.
    """
    package = lambda c: F.concat(F.lit("package:"), c)
    file_ = lambda c: F.concat(F.lit("file:"), c)
    symbol = lambda c: F.concat(F.lit("symbol:"), c)
    of_files = files.select(X.dir_name(F.col("path")).alias("p")).unionByName(symbols.select(F.col("package_path").alias("p"))).distinct()
    nodes = _union(
        [
            of_files.select(package(F.col("p")).alias("id"), F.lit("package").alias("type"), F.col("p").alias("name")),
            files.select(file_(F.col("path")).alias("id"), F.lit("file").alias("type"), X.base_name(F.col("path")).alias("name")),
            symbols.select(symbol(F.col("id")).alias("id"), F.lit("symbol").alias("type"), "name"),
        ]
    ).dropDuplicates(["id"])
    edge = lambda df, s, t, kind: df.select(s.alias("src"), t.alias("dst"), kind.alias("kind"))
    calls = F.when(F.col("kind").isin("call", "function_reference", "method_reference"), "calls").otherwise("references")
    edges = _union(
        [
            edge(files, package(X.dir_name(F.col("path"))), file_(F.col("path")), F.lit("owns")),
            edge(symbols, file_(F.col("file_path")), symbol(F.col("id")), F.lit("contains")),
            edge(references, symbol(F.col("source")), symbol(F.col("target")), calls),
            edge(dependencies, package(F.col("src")), package(F.col("dst")), F.lit("depends_on")),
        ]
    ).distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select(F.concat(F.lit("rel:"), "src", F.lit("->"), "dst", F.lit(":"), "kind").alias("id"), "src", "dst", "kind")


def components_by_prefix(packages: DataFrame, path: str, segments: int = 2) -> DataFrame:
    """(component, package): packages by their first path segments."""
    head = F.array_join(F.slice(F.split(path, "/"), 1, segments), "/")
    return packages.select(head.alias("component"), F.col(path).alias("package")).distinct()


def component_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src, dst, n) between components; member: (id, component)."""
    s = member.select(F.col("id").alias("src"), F.col("component").alias("a"))
    t = member.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    got = edges.join(s, "src").join(t, "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return got.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def context(edges: DataFrame, ids: Column | None = None) -> DataFrame:
    """(id, kind, direction, others): for each node its sorted neighbours by kind and direction."""
    out = edges.select(F.col("src").alias("id"), "kind", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.where("src <> dst").select(F.col("dst").alias("id"), "kind", F.lit("in").alias("direction"), F.col("src").alias("other"))
    both = out.unionByName(into)
    if ids is not None:
        both = both.where(ids)
    return both.groupBy("id", "kind", "direction").agg(F.sort_array(F.collect_set("other")).alias("others"))


def resolve_types(uses: DataFrame, types: DataFrame) -> DataFrame:
    """uses (use_id, expr, package) with element, state and type_id.

    *T and []T are peeled; builtins, maps, channels and functions resolve as they are;
    then pkg.T by package name, T in the own package, and T anywhere (several: ambiguous).
    types: (id, name, package, package_name).
    """
    bare = F.regexp_replace("expr", r"^(\*|\[\d*\])+", "")
    q = uses.withColumn("element", bare)
    q = q.withColumn("_pkg", F.when(F.col("element").contains("."), F.split_part("element", F.lit("."), F.lit(1))))
    q = q.withColumn("_name", F.element_at(F.split("element", r"\."), -1))
    own = types.groupBy("name", "package").agg(F.min("id").alias("_own")).select(F.col("name").alias("_name"), "package", "_own")
    named = types.groupBy("name", "package_name").agg(F.min("id").alias("_qualified")).select(F.col("name").alias("_name"), F.col("package_name").alias("_pkg"), "_qualified")
    all_ = types.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("_any")).select(F.col("name").alias("_name"), "_n", "_any")
    j = q.join(own, ["_name", "package"], "left").join(named, ["_name", "_pkg"], "left").join(all_, "_name", "left")
    plain = F.col("_pkg").isNull()
    builtin = F.col("element").isin(BUILTIN_TYPES) | F.col("element").rlike(r"^(map\[|chan\b|func\b|interface\b|struct\b)")
    id_ = (
        F.when(builtin, F.lit(None)).when(~plain, F.col("_qualified")).when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_n") == 1, F.col("_any"))
    )
    state = (
        F.when(builtin, "resolved").when(id_.isNotNull(), "resolved").when(plain & (F.col("_n") > 1), "ambiguous").otherwise("unresolved")
    )
    return j.select(*uses.columns, "element", state.alias("state"), id_.alias("type_id"))


def alias_ends(aliases: DataFrame) -> DataFrame:
    """(id, end, is_cyclic): where each alias (id, target) leads to in the end, in the logarithm of the longest chain rounds."""
    return chase(aliases).select("id", "end", "is_cyclic")


def resolve_in_scope(uses: DataFrame, scopes: DataFrame, declarations: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(use_id, state, declaration): the nearest enclosing scope that declares the name.

    uses: (use_id, scope_id, name); scopes: (scope_id, parent_id); declarations: (id,
    scope_id, name).  Several there are ambiguous.
    """
    climb = scopes.select(F.col("scope_id").alias("start"), F.col("scope_id").alias("at"), F.lit(0).alias("level"))
    up = dealt(scopes.where("parent_id is not null").select(F.col("scope_id").alias("_s"), F.col("parent_id").alias("_p")))
    front = climb
    for level in itertools.count(1):
        if level > most_levels:
            raise ValueError(f"scopes nest deeper than {most_levels} levels, or in a circle")
        front = cut(front.join(up, F.col("at") == F.col("_s")).select("start", F.col("_p").alias("at"), F.lit(level).alias("level")))
        if front.isEmpty():
            break
        climb = climb.unionByName(front)
    d = declarations.select(F.col("id").alias("declaration"), F.col("scope_id").alias("at"), "name")
    hit = uses.withColumnRenamed("scope_id", "start").join(dealt(climb), "start").join(dealt(d), ["at", "name"])
    per = hit.groupBy("use_id", "level").agg(F.count("*").alias("n"), F.min("declaration").alias("declaration"))
    near = per.groupBy("use_id").agg(F.min_by(F.struct("n", "declaration"), "level").alias("r"))
    return uses.select("use_id").join(dealt(near), "use_id", "left").select(
        "use_id",
        F.when(F.col("r").isNull(), "unresolved").when(F.col("r.n") > 1, "ambiguous").otherwise("resolved").alias("state"),
        F.when(F.col("r.n") == 1, F.col("r.declaration")).alias("declaration"),
    )


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(parent, child): methods under their receiver's type in the same package, others under their package.

    symbols: (id, name, package_path, receiver).
    """
    own = F.regexp_replace("receiver", r"^\*", "")
    types = symbols.where("receiver = ''").select(F.col("id").alias("_type"), F.col("name").alias("_name"), F.col("package_path").alias("_p"))
    j = symbols.join(types, (own == F.col("_name")) & (F.col("package_path") == F.col("_p")) & (F.col("receiver") != ""), "left")
    return j.select(F.coalesce("_type", F.concat(F.lit("package:"), "package_path")).alias("parent"), F.col("id").alias("child"))


def child_packages(packages: DataFrame, root: str) -> DataFrame:
    """(package): direct children of a package path."""
    rest = F.expr(f"substring(path, {len(root) + 2})")
    return packages.where(F.col("path").startswith(root + "/")).select(F.concat(F.lit(root + "/"), F.split_part(rest, F.lit("/"), F.lit(1))).alias("package")).distinct()


def cross_file_dependencies(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src_file, dst_file, n, symbols): references that leave their file, by pair."""
    t = symbols.select(F.col("id").alias("target"), F.col("file_path").alias("dst_file"), "name")
    got = references.select(F.col("file_path").alias("src_file"), "target").join(t, "target").where("src_file <> dst_file")
    return got.groupBy("src_file", "dst_file").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("name")).alias("symbols"))


def shared_modules(dependencies: DataFrame) -> DataFrame:
    """(dependency, consumers, versions, compatible) of dependencies with several consumers (module, dependency, version)."""
    return (
        dependencies.groupBy("dependency")
        .agg(F.sort_array(F.collect_set("module")).alias("consumers"), F.sort_array(F.collect_set("version")).alias("versions"))
        .where(F.size("consumers") > 1)
        .withColumn("compatible", F.size("versions") == 1)
    )


def unused_imports(imports: DataFrame, references: DataFrame) -> DataFrame:
    """Imports (file, target) whose last segment begins no reference (file, target) of their file.

    The segment is an equi-key of the anti join, so files of any size stay hashed.
    """
    used = references.select("file", X.base_name(F.split_part("target", F.lit("."), F.lit(1))).alias("_k")).distinct()
    return imports.withColumn("_k", X.base_name(F.col("target"))).join(used, ["file", "_k"], "left_anti").drop("_k")


def removals(nodes: DataFrame, edges: DataFrame, group: Column) -> DataFrame:
    """(id, callers, cross, classification): what removing each node would break."""
    named = nodes.select("id", group.alias("_g"))
    s = named.select(F.col("id").alias("src"), F.col("_g").alias("_a"))
    t = named.select(F.col("id").alias("dst"), F.col("_g").alias("_b"))
    used = edges.where(F.col("kind").isin("calls", "depends_on")).join(s, "src").join(t, "dst")
    per = used.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_if(F.col("_a") != F.col("_b")).alias("cross"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = F.when(z("cross") > 0, "breaking").when(z("callers") > 0, "potentially_breaking").otherwise("safe")
    return named.join(per, "id", "left").select("id", z("callers").alias("callers"), z("cross").alias("cross"), kind.alias("classification"))
