"""Navigation over symbols and references, for all requests at once.

symbols: (id, name, kind, pkg, file, receiver, line, exported, ...); references: (src,
dst, kind, file, state, line, id, ...); calls: (src, dst); communications: (src, tgt).
A request is a row, so asking for one symbol and for all of them is the same join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Kinds of usage by kind of reference.
USAGE_KINDS = {
    "function_reference": "call", "method_reference": "call", "struct_reference": "type", "type_reference": "type",
    "interface_reference": "type", "variable_reference": "field", "constant_reference": "field",
}
TYPE_KINDS = ["struct", "type"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def definitions(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request, state, candidates, target_id): by id; else by a name: one valid, several ambiguous; else not_found."""
    r = requests.select(F.trim("request").alias("request")).distinct()
    ids = symbols.select(F.col("id").alias("request"), F.lit(True).alias("_by_id")).distinct()
    names = symbols.groupBy(F.col("name").alias("request")).agg(F.count("*").alias("_n"), F.min("id").alias("_one"))
    j = r.join(ids, "request", "left").join(names, "request", "left")
    by_id = F.coalesce(F.col("_by_id"), F.lit(False))
    return j.select(
        "request",
        F.when(by_id | (F.col("_n") == 1), "valid").when(F.col("_n") > 1, "ambiguous").otherwise("not_found").alias("state"),
        F.when(by_id, 1).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("candidates"),
        F.when(by_id, F.col("request")).when(F.col("_n") == 1, F.col("_one")).alias("target_id"),
    )


def declarations(symbols: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, declared_in, how): a method's declaration is in the first interface (by id) that lists its name, else its own.

    fields: (interface_id, field).
    """
    listed = fields.groupBy(F.col("field").alias("name")).agg(F.min("interface_id").alias("_i"))
    j = symbols.select("id", "name", "receiver").join(listed, "name", "left")
    in_interface = (F.col("receiver") != "") & F.col("_i").isNotNull()
    return j.select(
        "id",
        F.when(in_interface, F.col("_i")).otherwise(F.col("id")).alias("declared_in"),
        F.when(in_interface, "interface_contract").otherwise("symbol_declaration").alias("how"),
    )


def implementations(symbols: DataFrame, fields: DataFrame) -> DataFrame:
    """(interface_id, type_name, type_id): types whose methods (by receiver's name, in any package) have all fields.

    type_id is the type's symbol of the greatest id, or sym:<name> where none is declared.
    """
    need = fields.select("interface_id", F.col("field").alias("name")).distinct()
    total = need.groupBy("interface_id").agg(F.count("*").alias("_need"))
    has = symbols.where("receiver <> ''").select(F.regexp_replace("receiver", r"^\*", "").alias("type_name"), "name").distinct()
    got = has.join(need, "name").groupBy("interface_id", "type_name").agg(F.count("*").alias("_got"))
    full = got.join(total, "interface_id").where("_got = _need")
    types = symbols.where(F.col("kind").isin(TYPE_KINDS)).groupBy(F.col("name").alias("type_name")).agg(F.max("id").alias("_id"))
    return full.join(types, "type_name", "left").select("interface_id", "type_name", F.coalesce("_id", F.concat(F.lit("sym:"), "type_name")).alias("type_id"))


def go_to_package(symbols: DataFrame) -> DataFrame:
    """(package, files, symbols, first_file): where each package is."""
    return symbols.groupBy(F.col("pkg").alias("package")).agg(
        F.countDistinct("file").alias("files"), F.count("*").alias("symbols"), F.min("file").alias("first_file")
    )


def go_to_module(symbols: DataFrame) -> DataFrame:
    """(module, packages, files): modules are first path segments."""
    return symbols.groupBy(X.first_segment(F.col("pkg")).alias("module")).agg(
        F.countDistinct("pkg").alias("packages"), F.countDistinct("file").alias("files")
    )


def references_to(requests: DataFrame, references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, ref_id, source, source_name, package, kind): an unknown source has its id as name and its file's folder as package."""
    r = references.join(requests.select(F.col("request").alias("dst")).distinct(), "dst", "left_semi")
    s = symbols.select(F.col("id").alias("src"), F.col("name").alias("_name"), F.col("pkg").alias("_pkg"))
    return r.select("id", "src", "dst", "kind", "file").join(s, "src", "left").select(
        F.col("dst").alias("symbol"), F.col("id").alias("ref_id"), F.col("src").alias("source"), F.coalesce("_name", "src").alias("source_name"),
        F.coalesce("_pkg", X.dir_name(F.col("file"))).alias("package"), "kind",
    )


def usage_kind(kind: Column) -> Column:
    out = None
    for k, v in USAGE_KINDS.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise("general")


def usages(references: DataFrame, calls: DataFrame, used: DataFrame) -> DataFrame:
    """(symbol, source, kind): references by kind, call edges, and packages that use the symbol's name.

    used: (symbol, src): the packages that communicate through it.
    """
    return _union(
        [
            references.where("dst <> ''").select(F.col("dst").alias("symbol"), F.col("src").alias("source"), usage_kind(F.col("kind")).alias("kind")),
            calls.select(F.col("dst").alias("symbol"), F.col("src").alias("source"), F.lit("call").alias("kind")),
            used.select("symbol", F.col("src").alias("source"), F.lit("package").alias("kind")),
        ]
    )


def reverse_lookup(references: DataFrame, calls: DataFrame, implements: DataFrame) -> DataFrame:
    """(id, kind, sources): how many references, calls and implementing types lead to each entity; repeated ones count."""
    return _union(
        [
            references.where("dst <> ''").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("sources")).withColumn("kind", F.lit("references")),
            calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("sources")).withColumn("kind", F.lit("calls")),
            implements.groupBy(F.col("interface_id").alias("id")).agg(F.count("*").alias("sources")).withColumn("kind", F.lit("implements")),
        ]
    ).select("id", "kind", "sources")


def file_dependencies(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): references that leave their file, once for each pair of files."""
    t = symbols.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    got = references.where("dst <> ''").select(F.col("file").alias("src_file"), "dst").join(t, "dst").where("src_file <> dst_file")
    return got.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).distinct()


def dependency_lookup(pairs: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, other, direction, kind): each pair of files and of modules, seen from both ends."""

    def both(df, out, into):
        return df.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("outbound").alias("direction"), F.lit(out).alias("kind")).unionByName(
            df.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("inbound").alias("direction"), F.lit(into).alias("kind"))
        )

    return both(pairs, "cross_file_dependency", "cross_file_dependent").unionByName(both(modules, "module", "module"))


def relationship_lookup(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(id, source, target, kind, direction): containment of each symbol both ways, and its references out and in.

    A reference of a symbol to itself is outbound only.
    """
    own = symbols.select("id", "pkg")
    row = lambda df, i, s, t, kind, d: df.select(i.alias("id"), s.alias("source"), t.alias("target"), F.lit(kind).alias("kind"), F.lit(d).alias("direction"))
    c = F.col
    into = references.where("dst <> '' and src <> dst")
    return _union(
        [
            row(own, c("id"), c("pkg"), c("id"), "contains", "downward"),
            row(own, c("id"), c("id"), c("pkg"), "belongs_to", "upward"),
            row(references, c("src"), c("src"), c("dst"), "references", "outbound"),
            row(into, c("dst"), c("src"), c("dst"), "references", "inbound"),
        ]
    )


def package_hierarchy(symbols: DataFrame) -> DataFrame:
    """(package, files, children, exported): counts of a package's own files, the packages below it and its exported symbols."""
    own = symbols.groupBy(F.col("pkg").alias("package")).agg(F.countDistinct("file").alias("files"), F.count_if("exported").alias("exported"))
    parts = F.split("package", "/")
    above = own.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_above"), "package"
    )
    below = above.where("_above <> package").groupBy(F.col("_above").alias("package")).agg(F.count("*").alias("children"))
    return own.join(below, "package", "left").select("package", "files", F.coalesce("children", F.lit(0)).alias("children"), "exported")


def type_hierarchy(symbols: DataFrame, implements: DataFrame) -> DataFrame:
    """(id, interfaces, implementors): of each type and interface, how many it implements and how many implement it."""
    up = implements.groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("interfaces"))
    down = implements.groupBy(F.col("interface_id").alias("id")).agg(F.count("*").alias("implementors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = symbols.where(F.col("kind").isin(*TYPE_KINDS, "interface")).select("id")
    return own.join(up, "id", "left").join(down, "id", "left").select("id", zero("interfaces"), zero("implementors"))


def call_hierarchy(calls: DataFrame) -> DataFrame:
    """(id, incoming, outgoing): distinct callers and callees; a symbol that calls itself counts in both."""
    return calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("incoming")).join(
        calls.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("outgoing")), "id", "full_outer"
    ).select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))
