"""Joins: reference resolution, interface satisfaction, scopes, usages, anti joins, snapshot diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

from .intervals import innermost
from .rounds import dealt

#: Interfaces without methods that may be broadcast to all types.
MOST_EMPTY = 10_000


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with target and state.

    refs: (ref_id, candidate_id, name).  By id; else by a name that one symbol has
    (resolved) or several (ambiguous, no target); else unresolved_external.
    """
    ids = symbols.select(F.col("id").alias("candidate_id"), F.lit(True).alias("_by_id")).distinct()
    names = symbols.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("_only"))
    joined = refs.join(ids, "candidate_id", "left").join(names, "name", "left")
    return joined.select(
        *[c for c in refs.columns],
        F.when(F.col("_by_id"), F.col("candidate_id")).when(F.col("_n") == 1, F.col("_only")).alias("target_id"),
        F.when(F.col("_by_id") | (F.col("_n") == 1), "resolved")
        .when(F.col("_n") > 1, "ambiguous")
        .otherwise("unresolved_external")
        .alias("state"),
    )


def satisfied_interfaces(required: DataFrame, methods: DataFrame, same_package: bool = True, empty_holds: bool = False) -> DataFrame:
    """(type_id, interface_id): relational division of methods by required methods.

    required: (interface_id, package, name, signature), a name of null for an interface
    without methods; methods: (type_id, package, name, signature).  Signatures count only
    where both are filled.
    """
    need = required.where("name is not null").select("interface_id", F.col("package").alias("_p"), "name", F.col("signature").alias("_s")).distinct()
    total = need.groupBy("interface_id").agg(F.countDistinct("name").alias("_need"))
    fit = (F.coalesce("_s", F.lit("")) == "") | (F.coalesce("signature", F.lit("")) == "") | (F.col("_s") == F.col("signature"))
    met = methods.join(need, "name").where(fit)
    if same_package:
        met = met.where(F.col("package") == F.col("_p"))
    got = met.groupBy("type_id", "interface_id").agg(F.countDistinct("name").alias("_got"))
    out = got.join(total, "interface_id").where("_got = _need").select("type_id", "interface_id")
    if empty_holds:
        empty = required.select("interface_id").distinct().join(total, "interface_id", "left_anti")
        if empty.limit(MOST_EMPTY + 1).count() > MOST_EMPTY:  # every type holds every one of them
            raise ValueError(f"more than {MOST_EMPTY} interfaces without methods")
        out = out.unionByName(methods.select("type_id").distinct().join(F.broadcast(empty)).select("type_id", "interface_id"))
    return out


def enclosing_scope(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """The innermost scope of each point (point_id, file, line): least span, then first line, then least id."""
    spans = scopes.select(F.col("scope_id").alias("span_id"), "file", F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    return innermost(points.withColumn("at", F.col("line")), spans, ["file"]).withColumnRenamed("span_id", "scope_id")


def usages(refs: DataFrame, calls: DataFrame, communications: DataFrame, symbol: str) -> DataFrame:
    """(source, kind): all uses of a symbol, repeated ones included."""
    a = refs.where(F.col("target") == symbol).select("source", F.col("kind"))
    b = calls.where(F.col("callee") == symbol).select(F.col("caller").alias("source"), F.lit("call").alias("kind"))
    c = communications.where(F.col("tgt").endswith(symbol)).select(F.col("src").alias("source"), F.lit("package").alias("kind"))
    return a.unionByName(b).unionByName(c)


def unreferenced(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols whose id and name are no reference's target."""
    targets = refs.select(F.col("target").alias("_t")).where("_t is not null").distinct()
    return symbols.join(targets, F.col("id") == F.col("_t"), "left_anti").join(targets, F.col("name") == F.col("_t"), "left_anti")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): removed, added or changed between two snapshots."""
    b = before.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    change = (
        F.when(F.col("_in_a").isNull(), "removed").when(F.col("_in_b").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def package_communications(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, tgt, n_refs, symbols_used) between packages that differ."""
    s = dealt(symbols.select(F.col("id").alias("source"), F.col("package").alias("src")))
    t = dealt(symbols.select(F.col("id").alias("target"), F.col("package").alias("tgt"), "name"))
    joined = refs.join(s, "source").join(t, "target").where("src <> tgt")
    return joined.groupBy("src", "tgt").agg(F.count("*").alias("n_refs"), F.sort_array(F.collect_set("name")).alias("symbols_used"))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key, by a partial aggregate, so that a hot key is never gathered in one task."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return last.select("_row.*")


def suffix_resolution(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Import targets to internal packages: the longest suffix that is a package path, by an equi-join."""
    parts = F.split("target", "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    exploded = imports.select("*", F.explode(suffixes).alias("package"))
    hit = exploded.join(packages.select("package").distinct(), "package")
    return hit.groupBy("import_id").agg(F.max_by("package", F.struct(F.length("package"), "package")).alias("package"))


def _runs(parts: Column, first: int = 0) -> Column:
    """All runs of consecutive segments from the segment `first` on, joined."""
    n = F.size(parts)
    at = F.when(n > first, F.sequence(F.lit(first + 1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/"))))


def import_targets(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(import_id, package, form) of every import (import_id, source, target), source the package that it stands in.

    A target is cleaned first.  It names the longest package (package) that it is (exact), or that stands in it
    after a slash, up to its end or another slash (inside); else one with .. at the front is taken from its source
    (relative); else package and form are null.  The package "." is no target of the first two.  Runs of segments are
    keys of hash joins; each distinct target is looked up once.
    """
    p = packages.select("package").where("package is not null").distinct()
    i = imports.withColumn("_c", X.clean_path(F.coalesce("target", F.lit(""))))
    distinct = i.select("_c").distinct()
    runs = distinct.select("_c", F.explode(F.array_distinct(F.array_append(_runs(F.split("_c", "/"), 1), F.col("_c")))).alias("package")).where("package <> '.'")
    found = runs.join(p, "package").groupBy("_c").agg(F.max_by("package", F.struct(F.length("package"), "package")).alias("_found"))
    joined = F.when(F.col("_c").startswith("../"), X.clean_path(F.concat_ws("/", "source", "_c")))
    j = i.join(found, "_c", "left").withColumn("_joined", joined).join(p.select(F.col("package").alias("_joined"), F.lit(True).alias("_there")), "_joined", "left")
    form = F.when(F.col("_found") == F.col("_c"), "exact").when(F.col("_found").isNotNull(), "inside").when(F.col("_there"), "relative")
    return j.select("import_id", F.coalesce("_found", F.when(F.col("_there"), F.col("_joined"))).alias("package"), form.alias("form"))


def entity_modules(entities: DataFrame, modules: DataFrame, default: str = "main") -> DataFrame:
    """(id, module, how): the module of each entity (id), of modules (module, package), a package null for none.

    The longest package that an id begins with, up to a slash, a dot or its end, tells the module (prefix); else the
    longest module whose segments stand in the id (name); else it is `default`.  Of several the least counts.
    """
    ids = entities.select(F.trim("id").alias("id")).where("id <> ''").distinct()
    parts = F.split("id", r"[/.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.substring("id", F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    owner = modules.where("package is not null").groupBy("package").agg(F.min("module").alias("module"))
    by_prefix = ids.select("id", F.explode(ends).alias("package")).join(owner, "package").groupBy("id").agg(F.max_by("module", F.length("package")).alias("_prefix"))
    left = ids.join(by_prefix, "id", "left_anti")
    names = modules.select("module").where("module <> ''").distinct()
    runs = left.select("id", F.explode(F.array_distinct(_runs(F.split(F.translate("id", ".", "/"), "/")))).alias("_run"))
    named = runs.join(names.withColumn("_run", F.translate("module", ".", "/")), "_run").groupBy("id").agg(F.min_by("module", F.struct(-F.length("module"), "module")).alias("_name"))
    how = F.when(F.col("_prefix").isNotNull(), "prefix").when(F.col("_name").isNotNull(), "name").otherwise("default")
    return ids.join(by_prefix, "id", "left").join(named, "id", "left").select("id", F.coalesce("_prefix", "_name", F.lit(default)).alias("module"), how.alias("how"))


def outdated(installed: DataFrame, catalog: DataFrame, version) -> DataFrame:
    """Installed ids known to the catalog, and whether a later version is there; `version` parses a column."""
    joined = installed.join(catalog, "id")
    return joined.select("id", "current", "latest", (version(F.col("latest")) > version(F.col("current"))).alias("has_update"))
