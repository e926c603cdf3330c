"""Queries over the source-code relations, each beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as X
from ..functions import version as V
from ..operators import audit as A
from ..operators import graph as G
from ..operators import install as I
from ..operators import lookup as L
from ..operators import model as M
from ..operators import navigate as N
from ..operators import ranking as K
from ..operators import resolve as J
from ..operators import rules as R
from ..operators.rounds import dealt
from ..sources import scan as S
from . import code as S_
from .code import CALLS, COMMS, ENTRIES, PATHS, REFS, SYMBOLS, Code
from .queries import ORACLE_SQL, QUERIES, query
from .relations import Tables

_HUB = "pkg/math"  # the package that a change is asked about

# Lookups: one relation, equal columns

_SYMBOL_COLUMNS = ["id", "name", "kind", "pkg", "file"]
_REF_COLUMNS = ["id", "src", "dst", "kind", "file", "state"]


def _lookup(name_: str, relation: str, columns: list[str], **equal: str) -> None:
    """Register `name_`: the rows of a relation with the values given, by `lookup.find`."""
    table = {"symbols": SYMBOLS, "refs": REFS, "calls": CALLS}[relation]
    where = " AND ".join(f"{c} = '{v}'" for c, v in equal.items())
    frame = {"symbols": Code.symbols, "refs": Code.references, "calls": Code.calls}[relation]
    QUERIES[name_] = lambda spark, folder: L.find(frame(Code(Tables(spark, folder))), **equal).select(*columns)
    ORACLE_SQL[name_] = f"WITH {table} SELECT {', '.join(columns)} FROM {relation} WHERE {where}"


_lookup("symbols_by_package", "symbols", _SYMBOL_COLUMNS, pkg="pkg/math")
_lookup("symbols_by_file", "symbols", _SYMBOL_COLUMNS, file="pkg/math/f1.go")
_lookup("symbols_by_kind", "symbols", _SYMBOL_COLUMNS, kind="interface")
_lookup("symbols_by_name", "symbols", _SYMBOL_COLUMNS, name="Sym14")
_lookup("docs_for_symbol", "symbols", ["id", "doc"], name="Sym14")
_lookup("references_in_file", "refs", _REF_COLUMNS, file="cmd/server/f2.go")
_lookup("references_by_kind", "refs", _REF_COLUMNS, kind="struct_reference")
_lookup("references_by_state", "refs", _REF_COLUMNS, state="broken")
_lookup("references_of_package", "refs", _REF_COLUMNS, src_pkg="pkg/math", dst_pkg="pkg/service")


def _hub(symbols: DataFrame) -> DataFrame:
    """The symbols of the package asked about."""
    return symbols.where(F.col("pkg") == _HUB)


@query(f"WITH {REFS} SELECT r.id, r.src, r.dst, r.kind FROM refs r WHERE r.src IN (SELECT id FROM symbols WHERE pkg = '{_HUB}')")
def references_from(t: Tables) -> DataFrame:
    c = Code(t)
    return c.references().join(_hub(c.symbols()).select(F.col("id").alias("src")), "src", "left_semi").select("id", "src", "dst", "kind")


@query(f"WITH {REFS} SELECT r.id, r.src, r.dst, r.kind FROM refs r WHERE r.dst IN (SELECT id FROM symbols WHERE pkg = '{_HUB}')")
def references_to(t: Tables) -> DataFrame:
    c = Code(t)
    return c.references().join(_hub(c.symbols()).select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "src", "dst", "kind")


@query(f"WITH {SYMBOLS} SELECT id, pkg, file FROM symbols WHERE id = 'pkg/math.Sym14' OR id = (SELECT min(id) FROM symbols)")
def find_symbol(t: Tables) -> DataFrame:
    """One symbol by an id with blanks around it; the other is asked for by the least id."""
    s = Code(t).symbols().select("id", "pkg", "file")
    least = s.agg(F.min("id")).first()[0]
    extra = L.find(s, id="pkg/math.Sym14")
    return extra.unionByName(L.by_id(s, f"  {least} ")).distinct()


@query(
    f"""WITH {SYMBOLS} SELECT 'repository' AS scope, count(*) AS n, min(id) AS first FROM symbols
 UNION ALL SELECT 'package', count(*), min(id) FROM symbols WHERE pkg = 'pkg/math'
 UNION ALL SELECT 'package_suffix', count(*), min(id) FROM symbols WHERE pkg = 'math' OR ends_with(pkg, '/errors')
 UNION ALL SELECT 'file', count(*), min(id) FROM symbols WHERE file = 'pkg/math/f1.go'
 UNION ALL SELECT 'module', count(*), min(id) FROM symbols WHERE starts_with(file, 'internal/capabilities')"""
)
def list_scopes(t: Tables) -> DataFrame:
    """Every scope; "errors" is no package path, so the loose match by name or /errors decides."""
    s = Code(t).symbols().select("id", F.col("pkg").alias("package_path"), F.element_at(F.split("pkg", "/"), -1).alias("package_name"), F.col("file").alias("file_path"))
    asked = [("repository", "repository", ""), ("package", "package", "pkg/math"), ("package_suffix", "package", "errors"), ("file", "file", "pkg/math/f1.go"), ("module", "module", "internal/capabilities")]
    parts = [L.list_symbols(s, scope, target).agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit(name).alias("scope"), "n", "first") for name, scope, target in asked]
    return A._union(parts)


@query(f"WITH {SYMBOLS} SELECT id, name FROM symbols WHERE kind IN ('struct', 'interface') AND exported AND contains(lower(name), '2') AND pkg <> 'cmd/server'")
def filter_symbols(t: Tables) -> DataFrame:
    return L.filter_nodes(Code(t).symbols(), kinds=["struct", "interface"], name_part="2", where=F.col("exported") & (F.col("pkg") != "cmd/server")).select("id", "name")


# Navigation


@query(
    f"""WITH {SYMBOLS}, q AS (SELECT id AS request FROM symbols WHERE pkg = '{_HUB}' UNION SELECT name FROM symbols UNION SELECT 'no such thing'),
 n AS (SELECT name, count(*) AS n, min(id) AS one FROM symbols GROUP BY 1)
 SELECT request, CASE WHEN s.id IS NOT NULL OR n.n = 1 THEN 'valid' WHEN n.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS state, CASE WHEN s.id IS NOT NULL THEN 1 ELSE coalesce(n.n, 0) END AS candidates,
 CASE WHEN s.id IS NOT NULL THEN request WHEN n.n = 1 THEN one END AS target_id FROM q LEFT JOIN symbols s ON s.id = request LEFT JOIN n ON n.name = request"""
)
def go_to_definition(t: Tables) -> DataFrame:
    s = Code(t).symbols()
    asked = _hub(s).select(F.concat(F.lit(" "), "id").alias("request")).unionByName(s.select(F.col("name").alias("request")))
    return N.definitions(asked.unionByName(t.spark.range(1).select(F.lit("no such thing").alias("request"))), s)


_FIELDS = """fields AS (SELECT DISTINCT i.id AS interface_id, m.name AS field FROM (SELECT id, unnest([n // 6, n // 6 + 31, CASE WHEN n % 12 = 3 THEN n // 6 + 1 ELSE n // 6 END]) AS k FROM symbols WHERE kind = 'interface') i JOIN symbols m ON m.kind = 'method' AND m.n // 6 = k)"""


def _fields(c: Code) -> DataFrame:
    """(interface_id, field): an interface asks for the next method, one of the same receiver further on, and some for another's."""
    s = c.symbols().withColumn("k", F.floor(F.col("n") / 6).cast("long"))
    m = s.where("kind = 'method'").select("k", F.col("name").alias("field"))
    wanted = F.array(F.col("k"), F.col("k") + 31, F.when(F.col("n") % 12 == 3, F.col("k") + 1).otherwise(F.col("k")))
    i = s.where("kind = 'interface'").select(F.col("id").alias("interface_id"), F.explode(F.array_distinct(wanted)).alias("k"))
    return i.join(m, "k").select("interface_id", "field").distinct()


@query(
    f"""WITH {SYMBOLS}, {_FIELDS}, l AS (SELECT field, min(interface_id) AS i FROM fields GROUP BY 1)
 SELECT s.id, CASE WHEN receiver <> '' AND i IS NOT NULL THEN i ELSE s.id END AS declared_in, CASE WHEN receiver <> '' AND i IS NOT NULL THEN 'interface_contract' ELSE 'symbol_declaration' END AS how FROM symbols s LEFT JOIN l ON l.field = s.name"""
)
def go_to_declaration(t: Tables) -> DataFrame:
    c = Code(t)
    return N.declarations(c.symbols(), _fields(c))


_IMPLEMENTS = f"""{_FIELDS}, need AS (SELECT DISTINCT interface_id, field FROM fields),
 has AS (SELECT DISTINCT regexp_replace(receiver, '^\\*', '') AS type_name, name FROM symbols WHERE receiver <> ''),
 got AS (SELECT interface_id, type_name, count(*) AS n FROM has JOIN need ON field = name GROUP BY 1, 2),
 imp AS (SELECT got.interface_id, type_name, coalesce((SELECT max(id) FROM symbols WHERE name = type_name AND kind IN ('struct', 'type')), 'sym:' || type_name) AS type_id FROM got
 JOIN (SELECT interface_id, count(*) AS n FROM need GROUP BY 1) w ON w.interface_id = got.interface_id AND w.n = got.n)"""


def _implements(c: Code) -> DataFrame:
    return N.implementations(c.symbols(), _fields(c))


@query(f"WITH {SYMBOLS}, {_IMPLEMENTS} SELECT interface_id, type_name, type_id FROM imp")
def go_to_implementation(t: Tables) -> DataFrame:
    return _implements(Code(t))


@query(f"WITH {SYMBOLS} SELECT pkg AS package, count(DISTINCT file) AS files, count(*) AS symbols, min(file) AS first_file FROM symbols GROUP BY 1")
def go_to_package(t: Tables) -> DataFrame:
    return N.go_to_package(Code(t).symbols())


@query(f"WITH {SYMBOLS} SELECT split_part(pkg, '/', 1) AS module, count(DISTINCT pkg) AS packages, count(DISTINCT file) AS files FROM symbols GROUP BY 1")
def go_to_module(t: Tables) -> DataFrame:
    return N.go_to_module(Code(t).symbols())


@query(
    f"""WITH {SYMBOLS}, pk AS (SELECT DISTINCT pkg AS p FROM symbols), i AS (SELECT n, regexp_replace(pkg, '/[^/]*$', '') || '/service' AS j, CASE n % 6 WHEN 0 THEN pkg WHEN 1 THEN 'example.org/x/' || pkg WHEN 2 THEN 'example.org/' || pkg || '/sub' || n WHEN 3 THEN '../service' WHEN 4 THEN 'fmt' || n ELSE pkg END AS c FROM symbols),
 h AS (SELECT n, arg_max(p, (length(p), p)) AS p FROM i JOIN pk ON c = p OR suffix(c, '/' || p) OR contains(c, '/' || p || '/') GROUP BY 1)
 SELECT i.n AS import_id, CASE WHEN h.p IS NOT NULL THEN h.p WHEN n_rel THEN j END AS package, CASE WHEN h.p = c THEN 'exact' WHEN h.p IS NOT NULL THEN 'inside' WHEN n_rel THEN 'relative' END AS form FROM (SELECT *, i.n % 6 = 3 AND j IN (SELECT p FROM pk) AS n_rel FROM i) i LEFT JOIN h ON h.n = i.n"""
)
def import_targets(t: Tables) -> DataFrame:
    s = Code(t).symbols()
    n, k = F.col("n").cast("string"), F.col("n") % 6
    target = (
        F.when(k == 0, F.col("pkg")).when(k == 1, F.concat(F.lit("example.org/x/"), "pkg")).when(k == 2, F.concat(F.lit("example.org//"), "pkg", F.lit("/sub"), n))
        .when(k == 3, "../service").when(k == 4, F.concat(F.lit("fmt"), n)).otherwise(F.concat(F.lit("./x/../"), "pkg", F.lit("/")))
    )
    return J.import_targets(s.select(F.col("n").alias("import_id"), F.col("pkg").alias("source"), target.alias("target")), s.select(F.col("pkg").alias("package")))


@query(
    f"""WITH {SYMBOLS}, m AS (SELECT DISTINCT 'mod/' || split_part(pkg, '/', 1) AS module, pkg AS package FROM symbols WHERE NOT contains(pkg, 'vec') AND NOT contains(pkg, 'after') AND NOT contains(pkg, 'tools')),
 h AS (SELECT id, arg_max(module, length(package)) AS module FROM (SELECT DISTINCT id FROM symbols) JOIN m ON id = package OR starts_with(id, package || '/') OR starts_with(id, package || '.') GROUP BY 1)
 SELECT DISTINCT s.id, coalesce(h.module, CASE WHEN starts_with(s.id, 'tools/') THEN 'tools' ELSE 'main' END) AS module, CASE WHEN h.module IS NOT NULL THEN 'prefix' WHEN starts_with(s.id, 'tools/') THEN 'name' ELSE 'default' END AS how FROM symbols s LEFT JOIN h ON h.id = s.id"""
)
def entity_modules(t: Tables) -> DataFrame:
    """Three packages belong to no module: one lies in another's folder, one is named like a module, one has none."""
    s = Code(t).symbols()
    owned = s.where(~F.col("pkg").rlike("vec|after|tools")).select(F.concat(F.lit("mod/"), F.split_part("pkg", F.lit("/"), F.lit(1))).alias("module"), F.col("pkg").alias("package")).distinct()
    modules = owned.unionByName(t.spark.range(1).select(F.lit("tools").alias("module"), F.lit(None).cast("string").alias("package")))
    return J.entity_modules(s, modules)


@query(
    f"""WITH {REFS} SELECT r.dst AS symbol, r.id AS ref_id, r.src AS source, coalesce(s.name, r.src) AS source_name, coalesce(s.pkg, regexp_replace(r.file, '/[^/]*$', '')) AS package, r.kind
 FROM refs r LEFT JOIN symbols s ON s.id = r.src WHERE r.dst IN (SELECT id FROM symbols WHERE pkg = '{_HUB}')"""
)
def find_references(t: Tables) -> DataFrame:
    c = Code(t)
    s = c.symbols()
    return N.references_to(_hub(s).select(F.col("id").alias("request")), c.references(), s)


@query(
    f"""WITH {CALLS}, u AS (SELECT dst AS symbol, src AS source, CASE WHEN kind IN ('function_reference', 'method_reference') THEN 'call' WHEN kind IN ('struct_reference', 'type_reference', 'interface_reference') THEN 'type' ELSE 'field' END AS kind FROM refs WHERE dst <> ''
 UNION ALL SELECT dst, src, 'call' FROM calls UNION ALL SELECT DISTINCT dst, src_pkg, 'package' FROM refs WHERE dst <> '' AND src_pkg <> dst_pkg)
 SELECT symbol, kind, count(*) AS n, count(DISTINCT source) AS sources FROM u GROUP BY 1, 2"""
)
def find_usages(t: Tables) -> DataFrame:
    """All usages of all symbols, counted by kind."""
    c = Code(t)
    r = c.references()
    used = r.where("dst <> '' and src_pkg <> dst_pkg").select(F.col("dst").alias("symbol"), F.col("src_pkg").alias("src")).distinct()
    return N.usages(r, c.calls(), used).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(
    f"""WITH {CALLS}, {_IMPLEMENTS} SELECT dst AS id, 'references' AS kind, count(*) AS sources FROM refs WHERE dst <> '' GROUP BY 1
 UNION ALL SELECT dst, 'calls', count(*) FROM calls GROUP BY 1 UNION ALL SELECT interface_id, 'implements', count(*) FROM imp GROUP BY 1"""
)
def reverse_lookup(t: Tables) -> DataFrame:
    c = Code(t)
    return N.reverse_lookup(c.references(), c.calls(), _implements(c))


_FILE_DEPS = "fd AS (SELECT DISTINCT r.file AS src, s.file AS dst FROM refs r JOIN symbols s ON s.id = r.dst WHERE r.file <> s.file)"


@query(
    f"""WITH {REFS}, {_FILE_DEPS}, md AS (SELECT DISTINCT split_part(src_pkg, '/', 1) AS src, split_part(dst_pkg, '/', 1) AS dst FROM refs WHERE dst <> '' AND split_part(src_pkg, '/', 1) <> split_part(dst_pkg, '/', 1))
 SELECT src AS id, dst AS other, 'outbound' AS direction, 'cross_file_dependency' AS kind FROM fd UNION ALL SELECT dst, src, 'inbound', 'cross_file_dependent' FROM fd
 UNION ALL SELECT src, dst, 'outbound', 'module' FROM md UNION ALL SELECT dst, src, 'inbound', 'module' FROM md"""
)
def dependency_lookup(t: Tables) -> DataFrame:
    c = Code(t)
    r = c.references()
    a, b = X.first_segment(F.col("src_pkg")), X.first_segment(F.col("dst_pkg"))
    modules = r.where((F.col("dst") != "") & (a != b)).select(a.alias("src"), b.alias("dst")).distinct()
    return N.dependency_lookup(N.file_dependencies(r, c.symbols()), modules)


@query(
    f"""WITH {REFS}, x AS (SELECT id, pkg AS source, id AS target, 'contains' AS kind, 'downward' AS direction FROM symbols UNION ALL SELECT id, id, pkg, 'belongs_to', 'upward' FROM symbols
 UNION ALL SELECT src, src, dst, 'references', 'outbound' FROM refs UNION ALL SELECT dst, src, dst, 'references', 'inbound' FROM refs WHERE dst <> '' AND src <> dst)
 SELECT id, kind, direction, count(*) AS n, min(source) AS first_source, max(target) AS last_target FROM x GROUP BY 1, 2, 3"""
)
def relationship_lookup(t: Tables) -> DataFrame:
    c = Code(t)
    got = N.relationship_lookup(c.symbols(), c.references())
    return got.groupBy("id", "kind", "direction").agg(F.count("*").alias("n"), F.min("source").alias("first_source"), F.max("target").alias("last_target"))


@query(
    f"""WITH {SYMBOLS}, o AS (SELECT pkg, count(DISTINCT file) AS files, count(*) FILTER (exported) AS exported FROM symbols GROUP BY 1)
 SELECT pkg AS package, files, (SELECT count(*) FROM o x WHERE starts_with(x.pkg, o.pkg || '/')) AS children, exported FROM o"""
)
def package_hierarchy(t: Tables) -> DataFrame:
    return N.package_hierarchy(Code(t).symbols())


@query(
    f"""WITH {SYMBOLS}, {_IMPLEMENTS} SELECT id, (SELECT count(*) FROM imp WHERE type_id = s.id) AS interfaces, (SELECT count(*) FROM imp WHERE interface_id = s.id) AS implementors FROM symbols s WHERE kind IN ('struct', 'interface')"""
)
def type_hierarchy(t: Tables) -> DataFrame:
    c = Code(t)
    return N.type_hierarchy(c.symbols(), _implements(c))


@query(f"WITH {CALLS} SELECT id, count(*) FILTER (d = 'in') AS incoming, count(*) FILTER (d = 'out') AS outgoing FROM (SELECT dst AS id, 'in' AS d FROM calls UNION ALL SELECT src, 'out' FROM calls) GROUP BY 1")
def call_hierarchy(t: Tables) -> DataFrame:
    return N.call_hierarchy(Code(t).calls())


@query(
    f"""WITH {SYMBOLS}, ty AS (SELECT name, pkg, min(id) AS id FROM symbols WHERE receiver = '' GROUP BY 1, 2) SELECT coalesce(CASE WHEN s.receiver <> '' THEN ty.id END, 'package:' || s.pkg) AS parent, s.id AS child
 FROM symbols s LEFT JOIN ty ON ty.name = regexp_replace(s.receiver, '^\\*', '') AND ty.pkg = s.pkg"""
)
def symbol_hierarchy(t: Tables) -> DataFrame:
    return M.hierarchy(Code(t).symbols().withColumnRenamed("pkg", "package_path"))


# Impact

_IMPACT = f"""tg AS (SELECT id AS target FROM symbols WHERE pkg = '{_HUB}'), direct AS (SELECT DISTINCT dst AS target, src AS id FROM refs WHERE dst <> '' AND src <> dst AND dst IN (SELECT target FROM tg)),
 up(target, id) AS (SELECT target, id FROM direct UNION SELECT up.target, c.src FROM up JOIN calls c ON c.dst = up.id WHERE c.src <> up.target),
 imp2 AS (SELECT target, id AS symbol, 'direct' AS how FROM direct UNION ALL SELECT target, id, 'transitive' FROM (SELECT * FROM up EXCEPT SELECT * FROM direct))"""


@query(f"WITH RECURSIVE {CALLS}, {_IMPACT} SELECT target, how, count(*) AS n, min(symbol) AS first FROM imp2 GROUP BY 1, 2")
def symbol_impact(t: Tables) -> DataFrame:
    """Over numbers in the order of ids, whose least is the least id's; symbols of near part numbers are called by much the same."""
    c = Code(t)
    s = c.numbered()
    r = c.numbered_references(s, _HUB)
    counts = A.impact_counts(r.where("asked"), r.where("called"), _hub(s).select(F.col("number").alias("target"), F.col("n").alias("near")))
    name = lambda of: dealt(s.select(F.col("number").alias(of), F.col("id").alias(f"_{of}")))
    return counts.join(name("target"), "target").join(name("first"), "first").select(F.col("_target").alias("target"), "how", "n", F.col("_first").alias("first"))


def _impact_sql(key: str) -> str:
    return f"""WITH RECURSIVE {CALLS}, {_IMPACT} SELECT t.{key} AS key, count(DISTINCT symbol) AS symbols, count(DISTINCT s.pkg) AS packages
 FROM imp2 JOIN symbols t ON t.id = target JOIN symbols s ON s.id = symbol WHERE t.{key} <> s.{key} GROUP BY 1"""


def _impact_of_keys(c: Code, key: str) -> DataFrame:
    """Over numbers instead of names, and references joined once."""
    s = c.numbered()
    r = c.numbered_references(s, _HUB)
    symbols = s.select(F.col("number").alias("id"), "pkg", "file")
    return A.impact_of_keys(r.where("asked"), r.where("called"), _hub(symbols).select(F.col("id").alias("target")), symbols, key)


@query(_impact_sql("file"))
def file_impact(t: Tables) -> DataFrame:
    return _impact_of_keys(Code(t), "file")


@query(_impact_sql("pkg"))
def package_impact(t: Tables) -> DataFrame:
    return _impact_of_keys(Code(t), "pkg")


@query(f"WITH {REFS} SELECT regexp_replace(src, '\\.[^.]*$', '') AS package, count(DISTINCT file) AS files FROM refs WHERE contains(dst, 'engine') GROUP BY 1")
def dependency_impact(t: Tables) -> DataFrame:
    return A.dependency_impact(Code(t).references(), "engine")


@query(
    f"""WITH {CALLS}, th AS (SELECT DISTINCT name FROM symbols WHERE pkg = 'pkg/service'), i AS (SELECT c.dst AS id, count(DISTINCT c.src) AS n FROM calls c JOIN symbols s ON s.id = c.src WHERE s.pkg <> 'pkg/service' GROUP BY 1),
 o AS (SELECT c.src AS id, count(DISTINCT c.dst) AS n FROM calls c JOIN symbols s ON s.id = c.dst WHERE s.pkg <> 'pkg/service' GROUP BY 1)
 SELECT s.id, th.name IS NOT NULL AS blocked, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, CASE WHEN th.name IS NOT NULL THEN 'blocked' WHEN coalesce(i.n, 0) > 0 OR coalesce(o.n, 0) > 0 THEN 'unsafe' ELSE 'safe' END AS verdict
 FROM symbols s LEFT JOIN th ON th.name = s.name LEFT JOIN i ON i.id = s.id LEFT JOIN o ON o.id = s.id WHERE s.pkg <> 'pkg/service'"""
)
def move_safety(t: Tables) -> DataFrame:
    c = Code(t)
    return A.move_safety(c.symbols(), c.calls(), "pkg/service")


# Rules

_UNUSED = "NOT EXISTS (SELECT 1 FROM refs WHERE dst = s.id) AND NOT EXISTS (SELECT 1 FROM refs WHERE dst = s.name)"


@query(
    f"""WITH {REFS} SELECT 'dead_code' AS rule, 'medium' AS severity, id AS target, pkg AS detail FROM symbols s WHERE name NOT IN ('main', 'init') AND NOT ends_with(file, '_test.go')
 AND NOT (exported AND NOT contains(pkg, 'internal')) AND kind <> 'interface' AND {_UNUSED}"""
)
def dead_code(t: Tables) -> DataFrame:
    c = Code(t)
    return A.dead_code(c.symbols(), c.references(), c.calls())


@query(f"WITH {REFS} SELECT 'unused_export' AS rule, 'low' AS severity, id AS target, pkg AS detail FROM symbols s WHERE exported AND contains(pkg, 'internal') AND NOT ends_with(file, '_test.go') AND {_UNUSED}")
def unused_exports(t: Tables) -> DataFrame:
    c = Code(t)
    return A.unused_exports(c.symbols(), c.references())


_IMPORTS = """im AS (SELECT DISTINCT file, CASE WHEN line % 20 = 0 THEN dst_pkg WHEN line % 30 = 0 THEN '_' || dst_pkg ELSE split_part(dst_pkg, '/', 2) END AS target FROM refs WHERE dst_pkg <> '' AND line < 60),
 us AS (SELECT DISTINCT file, dst AS target FROM refs WHERE dst <> '' AND state = 'broken')"""


@query(f"WITH {REFS}, {_IMPORTS} SELECT 'unused_import' AS rule, 'low' AS severity, file AS target, target AS detail FROM im WHERE NOT starts_with(target, '_') AND NOT EXISTS (SELECT 1 FROM us WHERE us.file = im.file AND contains('/' || replace(us.target, '.', '/') || '/', '/' || im.target || '/'))")
def unused_imports(t: Tables) -> DataFrame:
    """Imports are packages or their second segments; the targets that broken references ask for count as used."""
    r = Code(t).references()
    target = F.when(F.col("line") % 20 == 0, F.col("dst_pkg")).when(F.col("line") % 30 == 0, F.concat(F.lit("_"), "dst_pkg")).otherwise(F.split_part("dst_pkg", F.lit("/"), F.lit(2)))
    imports = r.where("dst_pkg <> '' and line < 60").select("file", target.alias("target")).distinct()
    return A.unused_imports(imports, r.where("dst <> '' and state = 'broken'").select("file", F.col("dst").alias("target")))


@query(f"WITH {SYMBOLS} SELECT 'large_function' AS rule, 'medium' AS severity, id AS target, (n % 120 + 1)::VARCHAR AS detail FROM symbols WHERE kind IN ('function', 'method') AND n % 7 <> 0 AND n % 120 + 1 > 80")
def large_functions(t: Tables) -> DataFrame:
    """A symbol's signature has as many lines as its number leaves; every seventh is marked as allowed."""
    n = F.col("n")
    signature = F.concat(F.lit("func"), F.repeat(F.lit("\n,"), (n % 120).cast("int")))
    return A.large_functions(Code(t).symbols(), signature, F.when(n % 7 == 0, "see @large_ok"))


@query(f"WITH {REFS} SELECT 'invalid_import' AS rule, 'high' AS severity, id AS target, state AS detail FROM refs WHERE state = 'broken' OR dst = ''")
def invalid_imports(t: Tables) -> DataFrame:
    return A.invalid_imports(Code(t).references())


def _comm_rule(name: str, rule: str, severity: str, where: str, operator) -> None:
    QUERIES[name] = lambda spark, folder: operator(Code(Tables(spark, folder)).communications())
    ORACLE_SQL[name] = f"WITH {COMMS} SELECT '{rule}' AS rule, '{severity}' AS severity, src AS target, tgt AS detail FROM comms WHERE {where}"


_RANK = """CASE WHEN regexp_matches(lower({0}), 'platform|filesystem|parser|language') THEN 1 WHEN regexp_matches(lower({0}), 'capabilities/repository|engine|repository') THEN 2
 WHEN contains(lower({0}), 'capabilities/intelligence') THEN 3 WHEN regexp_matches(lower({0}), 'cli|cmd') THEN 4 ELSE 0 END"""
_a, _b = _RANK.format("src"), _RANK.format("tgt")
_comm_rule("package_layers", "layer_violation", "high", f"({_a}) > 0 AND ({_b}) > 0 AND ({_a}) < ({_b})", R.layer_violations)
_comm_rule("architecture_violations", "architecture_violation", "critical", "(contains(src, 'platform') OR contains(src, 'engine')) AND contains(tgt, 'intelligence')", A.architecture_violations)
_comm_rule("module_boundaries", "module_boundary", "high", "(contains(tgt, '/internal/') OR starts_with(tgt, 'internal/')) AND split_part(src, '/', 1) <> split_part(tgt, '/', 1)", A.module_boundaries)
_comm_rule("layer_consistency", "layer_consistency", "low", "starts_with(src, 'cmd/') AND contains(tgt, 'capabilities/intelligence/navigation')", A.layer_consistency)


@query(f"WITH {PATHS} SELECT 'repository_organization' AS rule, 'info' AS severity, path AS target, 'root' AS detail FROM (SELECT DISTINCT path FROM paths) WHERE NOT contains(path, '/') AND ends_with(path, '.go') AND path <> 'main.go'")
def repository_organization(t: Tables) -> DataFrame:
    return A.repository_organization(Code(t).paths().select(F.col("path").alias("file")))


@query("SELECT 'missing_configuration' AS rule, 'medium' AS severity, 'repository' AS target, 'no build configuration' AS detail WHERE (SELECT count(*) FROM part WHERE p_size > 1000) = 0")
def missing_configuration(t: Tables) -> DataFrame:
    """There are no builds among parts above any size."""
    return A.missing_configuration(t.part.where("p_size > 1000"))


@query(
    f"""WITH {ENTRIES} SELECT 'deprecated_configuration' AS rule, 'low' AS severity, file || '#' || ordinal AS target, CASE lower(key) WHEN 'legacy_mode' THEN 'use feature_flags instead' WHEN 'enable_v1' THEN 'v1 endpoints are deprecated' ELSE 'migrate to oauth2 credentials' END AS detail
 FROM entries WHERE lower(key) IN ('legacy_mode', 'enable_v1', 'deprecated_token')
 UNION ALL SELECT 'invalid_configuration', 'high', key, file FROM entries WHERE lower(key) IN ('host', 'database') AND trim(value) = ''"""
)
def configuration_keys(t: Tables) -> DataFrame:
    e = Code(t).entries()
    return A.deprecated_configuration(e).unionByName(R.configuration(e).where("rule = 'invalid_configuration'"))


@query(
    f"""WITH {REFS}, f AS (SELECT 2.0 AS p FROM symbols s WHERE name NOT IN ('main', 'init') AND NOT ends_with(file, '_test.go') AND NOT (exported AND NOT contains(pkg, 'internal')) AND kind <> 'interface' AND pkg = 'internal/cli' AND {_UNUSED}
 UNION ALL SELECT 3.0 FROM symbols WHERE kind = 'function' AND pkg = 'internal/cli' AND n % 120 + 1 > 119) SELECT greatest(0, least(100, 100 - coalesce(sum(p), 0)))::DOUBLE AS score FROM f"""
)
def maintainability_score(t: Tables) -> DataFrame:
    """Of one package, by its dead code and its largest functions."""
    c = Code(t)
    cli = c.symbols().where("pkg = 'internal/cli'")
    large = A.large_functions(cli.where("kind = 'function'"), F.repeat(F.lit("\n"), (F.col("n") % 120).cast("int")), F.lit(None).cast("string"), 119)
    return A.maintainability(A.dead_code(cli, c.references(), c.calls()).unionByName(large))


_GRAPH = """pk AS (SELECT DISTINCT pkg AS id FROM symbols), pe AS (SELECT src_pkg AS src, dst_pkg AS dst, CASE line % 30 WHEN 0 THEN 'imports' WHEN 10 THEN 'depends_on' ELSE 'references' END AS kind FROM refs WHERE dst <> '' AND line <= 30)"""


def _package_graph(c: Code) -> tuple[DataFrame, DataFrame]:
    """(packages, edges): a relationship between packages for each early reference between their symbols."""
    kind = F.when(F.col("line") % 30 == 0, "imports").when(F.col("line") % 30 == 10, "depends_on").otherwise("references")
    edges = c.references().where("dst <> '' and line <= 30").select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst"), kind.alias("kind"))
    return c.symbols().select(F.col("pkg").alias("id")).distinct(), edges


@query(
    f"""WITH {REFS}, {_GRAPH}, d AS (SELECT id, (SELECT count(*) FROM pe WHERE src = id) + (SELECT count(*) FROM pe WHERE dst = id) AS n, (SELECT count(*) FROM pe WHERE src = id AND kind IN ('imports', 'depends_on')) AS o, (SELECT count(*) FROM pe WHERE dst = id AND kind IN ('imports', 'depends_on')) AS i FROM pk)
 SELECT 'complexity' AS insight, id, n FROM d WHERE n > 20 UNION ALL SELECT 'dependency', id, o FROM d WHERE o > 10 UNION ALL SELECT 'risk', id, i FROM d WHERE i > 8
 UNION ALL SELECT 'architecture', src || '->' || dst, count(*) FROM pe GROUP BY src, dst HAVING count(*) > 15
 UNION ALL SELECT 'growth', pkg, count(*) FROM symbols GROUP BY pkg HAVING count(*)::DOUBLE / (SELECT count(*) FROM symbols) > 0.08"""
)
def graph_insights(t: Tables) -> DataFrame:
    c = Code(t)
    packages, edges = _package_graph(c)
    return A.insights(packages, edges, c.symbols(), share=0.08)


@query(
    f"""WITH {CALLS}, {_GRAPH}, dep AS (SELECT src, dst FROM pe WHERE kind IN ('imports', 'depends_on')), api AS (SELECT * FROM symbols WHERE exported AND NOT ends_with(file, '_test.go'))
 SELECT DISTINCT 'break_cycle' AS rule, 'critical' AS priority, a.src AS id FROM dep a JOIN dep b ON a.src = b.dst AND a.dst = b.src
 UNION ALL SELECT 'reduce_fan_out', 'high', src FROM dep GROUP BY src HAVING count(*) >= 8
 UNION ALL SELECT 'remove_orphan', 'low', id FROM pk WHERE id NOT IN (SELECT src FROM pe) AND id NOT IN (SELECT dst FROM pe) AND id <> 'cmd' AND NOT starts_with(id, 'cmd/')
 UNION ALL SELECT DISTINCT 'invert_layer', 'high', src FROM pe WHERE kind = 'depends_on' AND contains(src, 'storage') AND contains(dst, 'service')
 UNION ALL SELECT 'relieve_hub', 'medium', dst FROM calls GROUP BY dst HAVING count(DISTINCT src) >= 10
 UNION ALL SELECT 'split_package', 'medium', pkg FROM symbols GROUP BY pkg HAVING count(DISTINCT file) >= 9
 UNION ALL SELECT 'document_api', 'info', id FROM api WHERE n % 5 <> 0
 UNION ALL SELECT 'unexport', 'low', id FROM api WHERE pkg <> 'main' AND NOT starts_with(pkg, 'cmd') AND id NOT IN (SELECT dst FROM calls)"""
)
def graph_recommendations(t: Tables) -> DataFrame:
    """All eight rules; every fifth symbol has a document."""
    c = Code(t)
    packages, edges = _package_graph(c)
    s = c.symbols()
    return A.recommendations(packages, edges, s, c.calls(), s.where("n % 5 = 0").select("id"), files=9)


# Checks


@query(
    f"""WITH {REFS} SELECT 'broken_reference' AS issue, id FROM refs WHERE state = 'broken' UNION ALL SELECT 'missing_symbol', id FROM refs WHERE state = 'resolved' AND dst NOT IN (SELECT id FROM symbols)
 UNION ALL SELECT 'duplicate_symbol', id FROM (SELECT id, file, line FROM symbols UNION ALL SELECT id, file, line + 1 FROM symbols WHERE n % 50 = 0) GROUP BY id HAVING count(DISTINCT (file, line)) > 1"""
)
def validate_references(t: Tables) -> DataFrame:
    """Every fiftieth symbol is declared a second time, a line below."""
    c = Code(t)
    s = c.symbols().select("id", "file", "line", "n")
    return A.validate_references(c.references(), s.unionByName(s.where("n % 50 = 0").withColumn("line", F.col("line") + 1)))


_TYPES = ["repository", "module", "package", "file", "symbol", "documentation", "configuration"]
_EDGE_KINDS = ["contains", "imports", "implements", "calls", "references", "depends_on", "documents", "configures", "owns"]


@query(
    f"""WITH n AS (SELECT 'n' || p_partkey AS id, {S_._list(_TYPES)}[(p_partkey % 7 + 1)::INT] AS type FROM part), e AS (SELECT l_orderkey || ':' || l_linenumber AS id, 'n' || l_partkey AS src, 'n' || l_suppkey AS dst, {S_._list(_EDGE_KINDS)}[(l_orderkey % 9 + 1)::INT] AS kind FROM lineitem)
 SELECT e.id FROM e JOIN n s ON s.id = e.src JOIN n d ON d.id = e.dst WHERE NOT CASE kind
 WHEN 'contains' THEN (s.type = 'repository' AND d.type IN ('module', 'package', 'documentation', 'configuration')) OR (s.type = 'module' AND d.type IN ('package', 'file', 'documentation', 'configuration')) OR (s.type = 'package' AND d.type IN ('file', 'documentation', 'configuration'))
  OR (s.type = 'file' AND d.type IN ('symbol', 'documentation', 'configuration')) OR (s.type = 'symbol' AND d.type = 'symbol')
 WHEN 'imports' THEN s.type IN ('file', 'package') AND d.type IN ('package', 'file') WHEN 'implements' THEN s.type = 'symbol' AND d.type = 'symbol' WHEN 'calls' THEN s.type = 'symbol' AND d.type = 'symbol'
 WHEN 'references' THEN s.type IN ('symbol', 'file', 'package') AND d.type = 'symbol' WHEN 'depends_on' THEN TRUE WHEN 'documents' THEN s.type = 'documentation' WHEN 'configures' THEN s.type = 'configuration' ELSE FALSE END"""
)
def edge_types(t: Tables) -> DataFrame:
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    nodes = t.part.select(node("p_partkey").alias("id"), S_._at(_TYPES, F.col("p_partkey") % 7).alias("type"))
    edges = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), node("l_partkey").alias("src"), node("l_suppkey").alias("dst"), S_._at(_EDGE_KINDS, F.col("l_orderkey") % 9).alias("kind"))
    return A.illegal_edges(nodes, edges)


# Kinds of files


def _case(column: str, dim: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dim.items()) + " END"


_BASE, _EXT = "regexp_extract(path, '([^/]*)$', 1)", "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1))"
_STEM = f"upper(regexp_replace({_BASE}, '\\.[^.]*$', ''))"


@query(
    f"""WITH {PATHS} SELECT id, path, {_case(_BASE, {'go.mod': 'go', 'package.json': 'npm', 'Cargo.toml': 'cargo', 'pom.xml': 'maven', 'build.gradle': 'gradle', 'build.gradle.kts': 'gradle', 'requirements.txt': 'python', 'pyproject.toml': 'python', 'setup.py': 'python', 'composer.json': 'composer'})} AS module,
 {_case(f'lower({_BASE})', {'makefile': 'make', 'gnumakefile': 'make', 'taskfile.yml': 'taskfile', 'cmakelists.txt': 'cmake', 'pom.xml': 'maven', 'build.gradle': 'gradle', 'build.gradle.kts': 'gradle', 'package.json': 'npm', 'pnpm-lock.yaml': 'pnpm', 'yarn.lock': 'yarn', 'cargo.toml': 'cargo'})} AS build,
 CASE WHEN {_EXT} IN ('.yaml', '.yml') THEN 'yaml' WHEN {_EXT} IN ('.json', '.toml', '.ini', '.properties', '.xml') THEN substr({_EXT}, 2) WHEN starts_with({_BASE}, '.env') OR {_BASE} = 'env' OR ends_with({_BASE}, '.env') THEN 'env' END AS config,
 CASE WHEN contains(path, '/adr/') OR starts_with({_STEM}, 'ADR') THEN 'adr' WHEN {_STEM} = 'README' THEN 'readme' WHEN {_STEM} = 'SECURITY' THEN 'security' WHEN {_STEM} IN ('LICENSE', 'COPYING') THEN 'license' WHEN {_STEM} IN ('HISTORY', 'CHANGES') THEN 'changelog' WHEN {_STEM} = 'ROADMAP' THEN 'roadmap'
  WHEN regexp_matches(path, '^(docs|doc)/') AND {_EXT} IN ('.md', '.txt', '.rst', '.adoc', '.html', '.pdf') THEN 'general' END AS doc,
 regexp_matches(lower(path), '(^|/)(vendor|node_modules|bower_components|venv|\\.venv)/') AS vendored, regexp_extract(path, '(?i)^((?:[^/]*/)*?(?:vendor|node_modules|bower_components|\\.venv|venv))/', 1) AS vendor_root,
 CASE WHEN regexp_matches(lower(path), '(^|/)vendor/') THEN 'go/php' WHEN regexp_matches(lower(path), '(^|/)(node_modules|bower_components)/') THEN 'npm' WHEN regexp_matches(lower(path), '(^|/)\\.venv/') THEN 'python' ELSE 'general' END AS ecosystem FROM paths"""
)
def file_kinds(t: Tables) -> DataFrame:
    p = F.col("path")
    root = C.vendor_root(p)
    return Code(t).paths().select(
        "id", "path", C.module_kind(p).alias("module"), C.build_system(p).alias("build"), C.config_kind(p).alias("config"), C.doc_kind(p).alias("doc"),
        C.is_vendored(p).alias("vendored"), root.alias("vendor_root"), C.vendor_ecosystem(root).alias("ecosystem"),
    )


@query(
    f"""WITH {PATHS}, x AS (SELECT *, {_BASE} AS base, {_EXT} AS ext FROM paths) SELECT id, CASE WHEN ends_with(path, '_test.go') THEN 'test' WHEN ends_with(base, '.bin') THEN 'binary' WHEN ext IN ('.md', '.txt', '.rst', '.adoc') OR starts_with(lower(base), 'readme') THEN 'documentation'
 WHEN ext IN ('.json', '.yaml', '.yml', '.toml', '.xml', '.ini', '.conf') THEN 'configuration' WHEN ext IN ('.go', '.py', '.html') OR base IN ('Makefile', 'Dockerfile', 'go.mod') THEN 'source' ELSE 'unknown' END AS kind,
 len(list_filter(string_split(path, '/'), lambda s: s IN ('.git', '.svn', '.hg', '.idea', '.vscode', 'node_modules', 'vendor', '.cache', '.DS_Store', 'Thumbs.db'))) > 0 AS ignored FROM x"""
)
def file_types(t: Tables) -> DataFrame:
    p = F.col("path")
    enc = F.when(p.endswith(".bin"), "Unknown").otherwise("UTF-8")
    return Code(t).paths().select("id", C.file_kind(p, S.language(p), S.is_test(p), enc).alias("kind"), X.any_segment_in(p, S.IGNORED).alias("ignored"))


_GENERATED = ["// Code generated by x. DO NOT EDIT.", "// code generated. do not edit", "/* @generated */", "AUTOGENERATED BY tool", "Code generated only", "DO NOT EDIT only", "plain"]


@query(
    f"""SELECT p_partkey AS id, (p_partkey % 7) IN (0, 2, 3) AND p_size % 60 < 50 AS generated FROM part"""
)
def generated_marks(t: Tables) -> DataFrame:
    """A mark after as many lines as the part's size, of which the first fifty count."""
    text = F.concat(F.repeat(F.lit("line\n"), (F.col("p_size") % 60).cast("int")), S_._at(_GENERATED, F.col("p_partkey") % 7))
    return t.part.select(F.col("p_partkey").alias("id"), C.is_generated(text).alias("generated"))


_LINES = ["code", "", "// c", "# c", "/* a */", "/* open", "still open", "  ", "closed */", "tail"]


@query(
    """WITH x AS (SELECT p_partkey AS id, p_size % 11 AS k FROM part) SELECT id, k::INT AS lines, (CASE WHEN k >= 2 THEN 1 ELSE 0 END + CASE WHEN k >= 8 THEN 1 ELSE 0 END)::INT AS blank,
 (CASE WHEN k >= 3 THEN 1 ELSE 0 END + CASE WHEN k >= 4 THEN 1 ELSE 0 END + CASE WHEN k >= 5 THEN 1 ELSE 0 END + CASE WHEN k >= 6 THEN 1 ELSE 0 END + CASE WHEN k >= 7 THEN 1 ELSE 0 END + CASE WHEN k >= 9 THEN 1 ELSE 0 END)::INT AS comments,
 CASE WHEN k < 2 THEN 'Unknown' WHEN id % 3 = 0 THEN 'LF' WHEN id % 3 = 1 THEN 'CRLF' WHEN k <= 3 THEN 'LF' ELSE 'Mixed' END AS ending FROM x"""
)
def comment_blocks(t: Tables) -> DataFrame:
    """The first lines of a file with comments and a block, one of them blank, with three ways to end lines."""
    k, id_ = (F.col("p_size") % 11).cast("int"), F.col("p_partkey")
    some = F.slice(F.array(*map(F.lit, _LINES)), F.lit(1), k)
    mixed = F.concat_ws("\n", F.slice(some, F.lit(1), F.least(k, F.lit(2))), F.when(k > 2, F.concat_ws("\r\n", F.slice(some, F.lit(3), F.greatest(k - 2, F.lit(0))))))
    text = F.when(id_ % 3 == 0, F.array_join(some, "\n")).when(id_ % 3 == 1, F.array_join(some, "\r\n")).otherwise(mixed)
    text = F.concat(text, F.when((k > 0) & (F.get(some, k - 1) == ""), F.when(id_ % 3 == 1, "\r\n").otherwise("\n")).otherwise(""))
    d = t.part.select(id_.alias("id"), C.line_counts(text).alias("c"), C.line_ending(text).alias("ending"))
    return d.select("id", F.col("c.total").alias("lines"), F.col("c.blank").alias("blank"), F.col("c.comment").alias("comments"), "ending")


# Versions, secrets

_LOOSE = ["1.2.3.4", " 1.x ", "V2.0", "^1.2.3-alpha.1+build123", "1.*", ">=1.0 || <2", "", "abc", "~>3.4", "v=7.8.9-rc-1"]
_LOOSE_OUT = [(1, 2, 3, "", "", False, True), (1, 0, 0, "", "", False, True), (2, 0, 0, "", "", False, True), (1, 2, 3, "alpha.1", "build123", True, True), (1, 0, 0, "", "", True, True),
              (1, 0, 0, "", "", True, True), (0, 0, 0, "", "", False, False), (0, 0, 0, "", "", False, False), (3, 4, 0, "", "", True, True), (7, 8, 9, "rc-1", "", False, True)]
_LOOSE_SQL = " UNION ALL ".join(
    f"SELECT {i} AS k, '{r.strip()}' AS raw, {a} AS major, {b} AS minor, {c} AS patch, '{p}' AS prerelease, '{q}' AS build, {str(x).upper()} AS is_constraint, {str(v).upper()} AS is_valid"
    for i, (r, (a, b, c, p, q, x, v)) in enumerate(zip(_LOOSE, _LOOSE_OUT, strict=True))
)


@query(f"WITH k AS ({_LOOSE_SQL}) SELECT p_partkey AS id, raw, major::BIGINT AS major, minor::BIGINT AS minor, patch::BIGINT AS patch, prerelease, build, is_constraint, is_valid FROM part JOIN k ON k = p_partkey % 10")
def loose_versions(t: Tables) -> DataFrame:
    v = V.parse_loose(S_._at(_LOOSE, F.col("p_partkey") % 10))
    return t.part.select(F.col("p_partkey").alias("id"), v.alias("v")).select("id", "v.*")


@query(f"WITH k AS ({_LOOSE_SQL}) SELECT p_partkey AS id, CASE WHEN is_valid THEN major || '.' || minor || '.' || patch || CASE WHEN prerelease <> '' THEN '-' || prerelease ELSE '' END || CASE WHEN build <> '' THEN '+' || build ELSE '' END ELSE raw END AS version FROM part JOIN k ON k = p_partkey % 10")
def rendered_versions(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), V.render_loose(V.parse_loose(S_._at(_LOOSE, F.col("p_partkey") % 10))).alias("version"))


@query(
    """WITH v AS (SELECT p_partkey AS id, p_size % 2 AS a, p_partkey % 3 AS b, p_partkey % 4 AS c FROM part), w AS (SELECT *, (a = 0 AND b = 2 AND c >= 1 OR a = 1) AS ge FROM v)
 SELECT id, CASE WHEN a <> 0 THEN 'major' WHEN b <> 2 THEN 'minor' WHEN c <> 1 THEN 'patch' ELSE 'none' END AS difference, CASE WHEN a = 0 THEN b = 2 AND c >= 1 ELSE FALSE END AS compatible, a || '.' || b || '.' || c AS rendered,
 ge AND b = 2 AS caret, ge AND a = 0 AND b = 2 AS tilde, (a > 0 OR b > 1 OR (b = 1 AND c >= 2)) AND NOT (a > 0 OR b > 2 OR (b = 2 AND c >= 3)) AS range_fits FROM w"""
)
def version_rules(t: Tables) -> DataFrame:
    """Against 0.2.1: ^0.2.1 asks for the same minor number whatever the major one."""
    raw = F.concat_ws(".", F.col("p_size") % 2, F.col("p_partkey") % 3, F.col("p_partkey") % 4)
    v, base = V.parse(F.concat(F.lit(" "), raw)), V.parse(F.lit("0.2.1"))
    parts = t.part.select("p_partkey", "p_size").repartition(t.tasks(), "p_partkey")  # a small file holds many, and their rules take long
    return parts.select(
        F.col("p_partkey").alias("id"), V.difference(base, v).alias("difference"), V.compatible(v, base).alias("compatible"), V.render(v).alias("rendered"),
        V.satisfies(F.lit("^0.2.1"), v).alias("caret"), V.satisfies(F.lit("~0.2.1"), v).alias("tilde"), V.satisfies(F.lit(">= 0.1.2, < 0.2.3"), v).alias("range_fits"),
    )


_KEYS = ["api_key", "Credential", "tls_cert", "bearer", "private", "private_key", "AUTHOR", "name", "db_password", "access"]


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 IN (0, 5, 6, 8) THEN '[REDACTED]' ELSE p_name END AS value, CASE WHEN p_partkey % 10 IN (7, 9) THEN 'conf/' || {S_._list(_KEYS)}[(p_partkey % 10 + 1)::INT] || '.json' ELSE '***MASKED_CONFIG***' END AS snippet FROM part"""
)
def secret_keys(t: Tables) -> DataFrame:
    """Findings hide fewer keys than searches mask."""
    key = S_._at(_KEYS, F.col("p_partkey") % 10)
    files = t.part.select(F.concat(F.lit("id"), "p_partkey").alias("id"), key.alias("name"), F.concat(F.lit("conf/"), key, F.lit(".json")).alias("path"), X.redact(key, F.col("p_name")).alias("value"))
    masked = L.search_configuration(files, "*", limit=1 << 30).select("id", "snippet")
    return files.join(masked, "id").select(F.substring("id", 3, 20).cast("long").alias("id"), "value", "snippet")


# Plugins

_PLUGINS = """pl AS (SELECT 'p' || s_suppkey AS id, (s_suppkey % 3) || '.' || (s_suppkey % 5) || '.0' AS version FROM supplier),
 dp AS (SELECT 'p' || l_suppkey AS id, 'p' || (l_partkey % 120) AS dependency, CASE WHEN l_linenumber % 2 = 0 THEN '>=1.0.0' ELSE '' END AS constraint, l_linenumber > 5 AS optional FROM lineitem)"""


@query(
    f"""WITH {_PLUGINS} SELECT dp.id, dependency, CASE WHEN pl.id IS NULL THEN 'missing' ELSE 'incompatible' END AS problem FROM dp LEFT JOIN pl ON pl.id = dependency
 WHERE (pl.id IS NULL AND NOT optional) OR (pl.id IS NOT NULL AND dp.constraint <> '' AND split_part(version, '.', 1)::INT < 1)"""
)
def plugin_plan(t: Tables) -> DataFrame:
    number = lambda c: F.concat(F.lit("p"), c.cast("string"))
    plugins = t.supplier.select(number(F.col("s_suppkey")).alias("id"), F.concat_ws(".", F.col("s_suppkey") % 3, F.col("s_suppkey") % 5, F.lit(0)).alias("version"))
    deps = t.lineitem.select(
        number(F.col("l_suppkey")).alias("id"), number(F.col("l_partkey") % 120).alias("dependency"), F.when(F.col("l_linenumber") % 2 == 0, ">=1.0.0").otherwise("").alias("constraint"), (F.col("l_linenumber") > 5).alias("optional")
    )
    return A.plan_checks(plugins, deps)


@query(
    """WITH c AS (SELECT p_brand AS id, p_size % 4 AS a, p_partkey % 7 AS b, p_size % 3 AS c, p_partkey % 5 <> 0 AS ok FROM part), w AS (SELECT DISTINCT p_brand AS id, unnest(['^1.2.0', '>=2.0.0,<3.0.0', '', '=9.9.9']) AS constraint FROM part),
 f AS (SELECT w.id, w.constraint, a, b, c FROM w JOIN c ON c.id = w.id AND ok AND CASE w.constraint WHEN '^1.2.0' THEN a = 1 AND b >= 2 WHEN '>=2.0.0,<3.0.0' THEN a = 2 WHEN '' THEN TRUE ELSE FALSE END)
 SELECT w.id, w.constraint, (SELECT arg_max(a || '.' || b || '.' || c, (a, b, c)) FROM f WHERE f.id = w.id AND f.constraint = w.constraint) AS version FROM w"""
)
def plugin_versions(t: Tables) -> DataFrame:
    catalog = t.part.select(F.col("p_brand").alias("id"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_partkey") % 7, F.col("p_size") % 3).alias("version"), (F.col("p_partkey") % 5 != 0).alias("discoverable"))
    wanted = catalog.select("id", F.explode(F.array(*map(F.lit, ["^1.2.0", ">=2.0.0,<3.0.0", "", "=9.9.9"]))).alias("constraint"))
    return A.best_versions(wanted, catalog)


_INSTALL = """cat AS (SELECT DISTINCT 'p' || l_suppkey AS id, (1 + l_partkey % 2) || '.' || (l_partkey % 3) || '.' || (l_linenumber % 2) AS version, l_partkey % 6 <> 2 AS ok FROM lineitem),
 raw AS (SELECT s_suppkey AS s, 1 AS o, 'p' || (s_suppkey // 2) AS d, '^1.0.0' AS k, FALSE AS optional FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, 2, 'p' || (s_suppkey // 3), CASE WHEN s_suppkey % 25 = 10 THEN '>=2.0.0' WHEN s_suppkey % 7 = 3 THEN '>=1.1.0' ELSE '^1.0.0' END, FALSE FROM supplier WHERE s_suppkey > 2
 UNION ALL SELECT s_suppkey, 3, 'p' || (s_suppkey * 2), '', TRUE FROM supplier WHERE s_suppkey % 37 = 30 UNION ALL SELECT s_suppkey, 4, 'x' || s_suppkey, '', s_suppkey % 2 = 0 FROM supplier WHERE s_suppkey % 41 = 16),
 dep AS (SELECT 'p' || s AS id, row_number() OVER (PARTITION BY s ORDER BY o) AS o, d, k, optional FROM raw),
 bst AS (SELECT k, id, max(version) AS version FROM (SELECT DISTINCT k FROM raw), cat WHERE ok AND CASE k WHEN '^1.0.0' THEN version < '2' WHEN '' THEN TRUE ELSE version >= k[3:] END GROUP BY 1, 2),
 q(target, qi, di, ids, vs, bad, what) AS (SELECT 'p' || s_suppkey, 1, 1, ['p' || s_suppkey], [v], CASE WHEN EXISTS (FROM cat WHERE cat.id = 'p' || s_suppkey AND cat.version = v) THEN NULL ELSE 'version_not_found' END, NULL::VARCHAR FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 7 THEN '3.0.0' ELSE '1.0.0' END AS v FROM supplier)
  UNION ALL SELECT target, CASE WHEN d IS NULL THEN qi + 1 ELSE qi END, CASE WHEN d IS NULL THEN 1 ELSE di + 1 END, CASE WHEN d IS NOT NULL AND seat IS NULL AND version IS NOT NULL THEN list_append(ids, d) ELSE ids END, CASE WHEN d IS NOT NULL AND seat IS NULL AND version IS NOT NULL THEN list_append(vs, version) ELSE vs END,
   CASE WHEN d IS NULL THEN NULL WHEN seat IS NULL AND version IS NULL AND NOT optional THEN CASE WHEN d IN (SELECT id FROM cat) THEN 'conflict' ELSE 'missing' END WHEN seat IS NOT NULL AND NOT CASE k WHEN '^1.0.0' THEN vs[seat] < '2' WHEN '' THEN TRUE ELSE vs[seat] >= k[3:] END THEN 'conflict' END, d
  FROM (SELECT q.*, dep.d, dep.k, dep.optional, bst.version, list_position(ids, dep.d) AS seat FROM q LEFT JOIN dep ON dep.id = ids[qi] AND dep.o = di LEFT JOIN bst ON bst.id = dep.d AND bst.k = dep.k WHERE bad IS NULL AND qi <= len(ids))),
 done AS (SELECT * FROM q WHERE bad IS NOT NULL OR qi > len(ids)), pn AS (SELECT target, unnest(ids) AS id, unnest(vs) AS version FROM done WHERE bad IS NULL),
 pe AS (SELECT a.target, a.id AS src, dep.d AS dst FROM pn a JOIN dep ON dep.id = a.id JOIN pn b ON b.target = a.target AND b.id = dep.d),
 w(target, id, way, cyc) AS (SELECT target, id, [id], FALSE FROM pn UNION ALL SELECT w.target, dst, list_append(way, dst), list_contains(way, dst) FROM w JOIN pe ON pe.target = w.target AND pe.src = w.id WHERE NOT cyc),
 cy AS (SELECT DISTINCT target FROM w WHERE cyc), bw AS (SELECT target, id, min(way) AS way FROM w WHERE target NOT IN (SELECT target FROM cy) GROUP BY 1, 2)"""


@query(
    f"""WITH RECURSIVE {_INSTALL} SELECT target, id, version, row_number() OVER (PARTITION BY target ORDER BY list_append(way, '~')) AS place, NULL::VARCHAR AS problem FROM bw JOIN pn USING (target, id)
 UNION ALL SELECT target, what, NULL, 0, bad FROM done WHERE bad IS NOT NULL UNION ALL SELECT target, NULL, NULL, 0, 'cycle' FROM cy"""
)
def plugin_plans(t: Tables) -> DataFrame:
    """Every supplier is a plugin that needs those of a half and a third of its number; some need one of twice theirs, or one that isn't there."""
    s = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    line = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber")
    catalog = line.select(name(F.col("l_suppkey")).alias("id"), F.concat_ws(".", 1 + F.col("l_partkey") % 2, F.col("l_partkey") % 3, F.col("l_linenumber") % 2).alias("version"), (F.col("l_partkey") % 6 != 2).alias("discoverable")).distinct()
    need = lambda n, when, d, k, optional: F.when(when, F.struct(F.lit(n).alias("ordinal"), d.alias("dependency"), k.alias("constraint"), optional.alias("optional")))
    half, third = F.floor(s / 2).cast("long"), F.floor(s / 3).cast("long")
    needs = F.array(
        need(1, s > 1, name(half), F.lit("^1.0.0"), F.lit(False)), need(2, s > 2, name(third), F.when(s % 25 == 10, ">=2.0.0").when(s % 7 == 3, ">=1.1.0").otherwise("^1.0.0"), F.lit(False)),
        need(3, s % 37 == 30, name(s * 2), F.lit(""), F.lit(True)), need(4, s % 41 == 16, F.concat(F.lit("x"), s.cast("string")), F.lit(""), s % 2 == 0),
    )
    deps = t.supplier.select(name(s).alias("id"), F.explode(F.array_compact(needs)).alias("r")).select("id", "r.*")
    targets = t.supplier.select(name(s).alias("target"), F.when(s % 13 == 7, "3.0.0").otherwise("1.0.0").alias("version"))
    return I.plans(targets, catalog, deps).withColumn("place", F.coalesce("place", F.lit(0)))


_ORDERS = {"downloads": "d DESC", "rating": "r DESC, c DESC", "name": "lower(p_name) DESC"}


@query(
    "WITH x AS (SELECT *, p_partkey % 100 AS d, p_size % 5 + 1 AS r, p_size AS c FROM part) "
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS way, row_number() OVER (ORDER BY {v}, 'part:' || p_partkey)::INT AS place, 'part:' || p_partkey AS id FROM x) WHERE place <= 30" for k, v in _ORDERS.items())
)
def catalog_orders(t: Tables) -> DataFrame:
    """The first thirty of the catalogue by each way of sorting."""
    parts = []
    for way in _ORDERS:
        top = L.page(t.items(), A.ordered(t.items(), way), 0, 30).select("id")
        parts.append(top.withColumn("way", F.lit(way)))
    ranked = A._union(parts).join(t.items(), "id")
    from pyspark.sql import Window

    out = []
    for way in _ORDERS:
        w = Window.partitionBy("way").orderBy(*A.ordered(ranked, way))
        out.append(ranked.where(F.col("way") == way).select("way", F.row_number().over(w).alias("place"), "id"))
    return A._union(out)


# Statistics and contexts


@query(f"WITH {REFS} SELECT dst AS dependency, count(DISTINCT src_pkg) AS consumers, count(*) AS uses, count(DISTINCT kind) AS kinds FROM refs WHERE dst <> '' GROUP BY 1")
def dependency_inventory(t: Tables) -> DataFrame:
    r = Code(t).references().where("dst <> ''")
    return K.inventory(r, "dst", "src_pkg", "kind").withColumnRenamed("dst", "dependency")


@query("SELECT CASE WHEN contains(upper(text), 'MIT') THEN 'MIT' WHEN contains(upper(text), 'APACHE') THEN 'APACHE' WHEN contains(upper(text), 'BSD') THEN 'BSD' WHEN contains(upper(text), 'LGPL') THEN 'LGPL' WHEN contains(upper(text), 'GPL') THEN 'GPL' WHEN contains(upper(text), 'MPL') THEN 'MPL' ELSE 'UNKNOWN' END AS family, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1")
def license_inventory(t: Tables) -> DataFrame:
    return t.documents.groupBy(X.license_family(F.col("text")).alias("family")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))


@query("SELECT event_type AS author, 'u' || (user_id % 10) AS email, count(*) AS commits, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2")
def contributors(t: Tables) -> DataFrame:
    return S.contributors(t.events.select(F.col("event_type").alias("author"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("email"), "ts"))


@query("SELECT count(*) AS commits, 'sha' || min(event_id) AS first_sha, 'sha' || max(event_id) AS last_sha, min(ts) AS first, max(ts) AS last FROM events")
def commit_stats(t: Tables) -> DataFrame:
    return S.commit_stats(t.events.select(F.col("event_id").alias("ordinal"), F.concat(F.lit("sha"), "event_id").alias("new"), "ts"))


@query("SELECT 'v' || (p_size % 4) || '.' || (p_partkey % 9) || CASE p_partkey % 4 WHEN 1 THEN '-RC1' WHEN 2 THEN '-beta' ELSE '' END AS tag, CASE p_partkey % 4 WHEN 1 THEN 'rc' WHEN 2 THEN 'beta' END AS prerelease FROM part WHERE p_partkey % 6 <> 0")
def releases(t: Tables) -> DataFrame:
    number = F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_partkey") % 9), F.when(F.col("p_partkey") % 4 == 1, "-RC1").when(F.col("p_partkey") % 4 == 2, "-beta").otherwise(""))
    return S.releases(t.part.select(F.when(F.col("p_partkey") % 6 == 0, "nightly").otherwise(number).alias("tag")))


@query("SELECT 'https://host.org/' || p_brand || '/repo.git' AS url, p_brand AS owner, p_partkey AS id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'git@host.org:' || p_brand || '/repo.git', p_brand, p_partkey FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'plain', '', p_partkey FROM part WHERE p_partkey % 3 = 2")
def url_owners(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 3
    url = F.when(n == 0, F.concat(F.lit("https://host.org/"), "p_brand", F.lit("/repo.git"))).when(n == 1, F.concat(F.lit("git@host.org:"), "p_brand", F.lit("/repo.git"))).otherwise("plain")
    return t.part.select(url.alias("url"), X.owner_of_url(url).alias("owner"), F.col("p_partkey").alias("id"))


@query(f"WITH {CALLS} SELECT id, 'calls' AS kind, direction, string_agg(other, ',' ORDER BY other) AS others FROM (SELECT src AS id, 'out' AS direction, dst AS other FROM calls UNION SELECT dst, 'in', src FROM calls WHERE src <> dst) WHERE id IN (SELECT id FROM symbols WHERE pkg = '{_HUB}') GROUP BY 1, 3")
def symbol_context(t: Tables) -> DataFrame:
    c = Code(t)
    return M.context(c.calls(), F.col("id").startswith(_HUB + ".")).withColumn("others", F.array_join("others", ","))


@query(f"WITH {COMMS} SELECT 'package:' || src AS src, 'package:' || tgt AS dst, n FROM comms")
def communications(t: Tables) -> DataFrame:
    """The same counts as Code.communications, by the operator over references and symbols."""
    from ..operators import resolve as J

    c = Code(t)
    refs = c.references().where("state = 'resolved' and dst <> ''").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    got = J.package_communications(refs, c.symbols().withColumnRenamed("pkg", "package"))
    p = lambda x: F.concat(F.lit("package:"), x)
    return got.select(p("src").alias("src"), p("tgt").alias("dst"), F.col("n_refs").alias("n"))


@query(f"WITH {REFS}, {_FILE_DEPS} SELECT r.file AS src_file, s.file AS dst_file, count(*) AS n FROM refs r JOIN symbols s ON s.id = r.dst WHERE r.file <> s.file GROUP BY 1, 2")
def cross_files(t: Tables) -> DataFrame:
    c = Code(t)
    refs = c.references().where("dst <> ''").select(F.col("file").alias("file_path"), F.col("dst").alias("target"))
    return M.cross_file_dependencies(refs, c.symbols().withColumnRenamed("file", "file_path")).select("src_file", "dst_file", "n")


@query(
    f"""WITH {CALLS} SELECT 'symbol:' || id AS id, coalesce((SELECT count(*) FROM calls c JOIN symbols x ON x.id = c.src WHERE c.dst = s.id), 0) AS callers, coalesce((SELECT count(*) FROM calls c JOIN symbols x ON x.id = c.src WHERE c.dst = s.id AND x.pkg <> s.pkg), 0) AS cross,
 CASE WHEN EXISTS (SELECT 1 FROM calls c JOIN symbols x ON x.id = c.src WHERE c.dst = s.id AND x.pkg <> s.pkg) THEN 'breaking' WHEN EXISTS (SELECT 1 FROM calls c WHERE c.dst = s.id) THEN 'potentially_breaking' ELSE 'safe' END AS classification FROM symbols s"""
)
def symbol_removal(t: Tables) -> DataFrame:
    c = Code(t)
    got = M.removals(c.symbols(), c.calls(), F.col("pkg"))
    return got.withColumn("id", F.concat(F.lit("symbol:"), "id"))


@query(f"WITH {COMMS} SELECT 'orphan_package' AS rule, 'low' AS severity, id AS target, 'no edges' AS detail FROM (SELECT DISTINCT pkg AS id FROM symbols UNION SELECT 'lonely/' || p_brand FROM part) WHERE id NOT IN (SELECT src FROM comms UNION SELECT tgt FROM comms) AND NOT regexp_matches(id, 'cmd|test|tools')")
def orphan_packages(t: Tables) -> DataFrame:
    c = Code(t)
    lonely = t.part.select(F.concat(F.lit("lonely/"), "p_brand").alias("id"))
    nodes = c.symbols().select(F.col("pkg").alias("id")).unionByName(lonely).distinct()
    return R.orphan_packages(nodes, c.communications().select("src", F.col("tgt").alias("dst")))


@query(f"WITH RECURSIVE {COMMS}, p(first, node, path) AS (SELECT src, tgt, [src] FROM comms WHERE tgt >= src UNION ALL SELECT first, tgt, list_append(path, node) FROM p JOIN comms ON node = src WHERE node <> first AND len(path) < 3 AND tgt >= first AND NOT list_contains(path, node)) SELECT DISTINCT 'circular_dependency' AS rule, 'critical' AS severity, array_to_string(list_append(path, first), ' -> ') AS target, array_to_string(list_append(path, first), ' -> ') AS detail FROM p WHERE node = first")
def circular_dependencies(t: Tables) -> DataFrame:
    """Of packages, by cycles of three at most, each named from its least package."""
    e = Code(t).communications().select(F.concat_ws("->", "src", "tgt").alias("id"), "src", F.col("tgt").alias("dst"), F.lit("depends_on").alias("kind"))
    return R.circular_dependencies(G.cycles(e, 3))
