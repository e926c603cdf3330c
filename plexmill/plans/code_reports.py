"""Queries of listings, profiles, contexts and checks, each beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as X
from ..operators import audit as A
from ..operators import graph as G
from ..operators import intervals as IV
from ..operators import model as M
from ..operators import navigate as N
from ..operators import pointers as PT
from ..operators import ranking as K
from ..operators import report as P
from ..operators.rounds import dealt
from ..sources import golang as GO
from ..sources import incremental as GI
from ..sources import repository as RP
from ..sources import scan as S
from ..streaming import events as E

from .code import CALLS, PATHS, REFS, SYMBOLS, Code
from .code_queries import _FILE_DEPS, _IMPLEMENTS, _UNUSED, _implements
from .queries import query
from .relations import Tables


@query(f"WITH {SYMBOLS} SELECT pkg AS package, count(*) AS symbols FROM symbols WHERE contains(lower(pkg), 'er') AND starts_with(pkg, 'internal') GROUP BY 1 ORDER BY 1 LIMIT 50 OFFSET 1")
def packages_page(t: Tables) -> DataFrame:
    return P.packages_page(Code(t).symbols(), "ER", "internal", 1)


@query(f"WITH {SYMBOLS} SELECT pkg AS package, file, count(*) AS symbols FROM symbols GROUP BY 1, 2")
def package_files(t: Tables) -> DataFrame:
    return Code(t).symbols().groupBy(F.col("pkg").alias("package"), "file").agg(F.count("*").alias("symbols"))


@query(f"WITH {SYMBOLS} SELECT id, name FROM symbols WHERE lower(name) = 'sym14' ORDER BY id LIMIT 1")
def lookup_symbol(t: Tables) -> DataFrame:
    """No id is " SYM14 ", so the first search hit of that name counts."""
    return P.lookup_symbol(Code(t).symbols(), " SYM14 ")


_NODES = "nd AS (SELECT id, kind AS type, pkg FROM symbols)"


@query(
    f"""WITH RECURSIVE {CALLS}, {_NODES}, r(id, depth) AS (SELECT (SELECT min(src) FROM calls), 0 UNION SELECT dst, depth + 1 FROM r JOIN calls ON src = r.id WHERE depth < 3)
 SELECT nd.id, min(depth)::INT AS depth FROM r JOIN nd ON nd.id = r.id WHERE type IN ('struct', 'method') AND starts_with(pkg, 'internal') GROUP BY 1"""
)
def traverse_nodes(t: Tables) -> DataFrame:
    c = Code(t)
    calls = c.calls()
    nodes = c.symbols().select("id", F.col("kind").alias("type"), "pkg")
    return P.traverse_nodes(nodes, calls, calls.agg(F.min("src")).first()[0], P.entity_filter(["STRUCT", "Method"], "internal")).select("id", "depth")


_FILES = f"""{PATHS}, fl AS (SELECT path, id % 1000 AS size, CASE WHEN ends_with(path, '.go') OR ends_with(path, 'go.mod') THEN 'go' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.html') THEN 'html' END AS language FROM paths)"""


def _files(t: Tables) -> DataFrame:
    p = F.col("path")
    known = F.when(S.language(p).isin("go", "python", "html"), S.language(p))
    return Code(t).paths().select("path", (F.col("id") % 1000).alias("size"), known.alias("language"))


@query(f"WITH {_FILES} SELECT count(*) AS files, count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END) AS directories, sum(size)::BIGINT AS bytes, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM fl")
def repository_profile(t: Tables) -> DataFrame:
    return P.profile(_files(t))


@query(
    f"""WITH {_FILES} SELECT 'language' AS statistic, language AS key, count(*) AS n FROM fl WHERE language IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'extension', lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1)), count(*) FROM fl GROUP BY 2 UNION ALL SELECT 'folder', split_part(path, '/', 1), count(*) FROM fl WHERE contains(path, '/') GROUP BY 2"""
)
def repository_statistics(t: Tables) -> DataFrame:
    p = F.col("path")
    return P.statistics(_files(t), language=F.col("language"), extension=X.extension(p), folder=F.when(p.contains("/"), X.first_segment(p)))


@query(
    f"""WITH {PATHS}, x AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths)
 SELECT directory, count(*) AS files, count(*) FILTER (base IN ('go.mod', 'package.json', 'Cargo.toml', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'requirements.txt', 'pyproject.toml', 'setup.py', 'composer.json')) AS modules,
 count(*) FILTER (lower(base) IN ('makefile', 'gnumakefile', 'taskfile.yml', 'cmakelists.txt', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'package.json', 'pnpm-lock.yaml', 'yarn.lock', 'cargo.toml')) AS builds,
 count(*) FILTER (regexp_matches(base, '\\.(yaml|yml|json|toml|ini|properties|xml)$') OR starts_with(base, '.env') OR base = 'env' OR ends_with(base, '.env')) AS configs,
 count(*) FILTER (contains(path, '/adr/') OR starts_with(base, 'ADR') OR upper(regexp_replace(base, '\\.[^.]*$', '')) IN ('README', 'SECURITY', 'LICENSE', 'COPYING', 'HISTORY', 'CHANGES', 'ROADMAP') OR (regexp_matches(path, '^docs?/') AND regexp_matches(base, '\\.(md|txt|rst|adoc|html|pdf)$'))) AS docs,
 count(*) FILTER (regexp_matches(lower(path), '(^|/)(vendor|node_modules|bower_components|venv|\\.venv)/')) AS vendored FROM x GROUP BY 1"""
)
def structure_model(t: Tables) -> DataFrame:
    return P.structure(Code(t).paths())


@query(
    f"""WITH {REFS}, ac AS (SELECT split_part(src_pkg, '/', 1) AS a, split_part(dst_pkg, '/', 1) AS b FROM refs WHERE dst <> '' AND split_part(src_pkg, '/', 1) <> split_part(dst_pkg, '/', 1))
 SELECT module, files, symbols, (SELECT count(*) FROM ac WHERE a = module) AS outgoing, (SELECT count(*) FROM ac WHERE b = module) AS incoming FROM (SELECT split_part(pkg, '/', 1) AS module, count(DISTINCT file) AS files, count(*) AS symbols FROM symbols GROUP BY 1)"""
)
def module_context(t: Tables) -> DataFrame:
    c = Code(t)
    return P.module_context(c.symbols(), c.references())


@query(f"WITH {CALLS} SELECT 'node' AS what, kind, count(*) AS n FROM symbols GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM refs WHERE dst <> '' GROUP BY 2")
def graph_info(t: Tables) -> DataFrame:
    """Also the counts that a repository's context lists."""
    c = Code(t)
    return P.graph_info(c.symbols().withColumn("type", F.col("kind")), c.references().where("dst <> ''"))


_PE = """pe AS (SELECT src_pkg AS src, dst_pkg AS dst, CASE WHEN line % 20 = 0 THEN 'depends_on' WHEN line % 30 = 0 THEN 'imports' ELSE 'references' END AS kind FROM refs WHERE dst <> '')"""


def _package_edges(c: Code) -> DataFrame:
    kind = F.when(F.col("line") % 20 == 0, "depends_on").when(F.col("line") % 30 == 0, "imports").otherwise("references")
    return c.references().where("dst <> ''").select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst"), kind.alias("kind"))


@query(f"WITH {REFS}, {_PE} SELECT src, dst, kind, count(*) AS n FROM pe WHERE kind IN ('depends_on', 'imports') AND (contains(lower(src), 'parser') OR contains(lower(dst), 'parser')) GROUP BY ALL")
def graph_dependency(t: Tables) -> DataFrame:
    return P.dependency_edges(_package_edges(Code(t)), "PARSER").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {REFS}, {_PE} SELECT DISTINCT src AS name, 'edge' AS source FROM pe WHERE kind = 'depends_on' AND lower(dst) = 'pkg/service' UNION ALL SELECT DISTINCT p_brand, 'declared' FROM part WHERE lower(p_brand) = 'brand#12'")
def lookup_dependencies(t: Tables) -> DataFrame:
    """One name is declared; the other isn't, so the edges into it count."""
    e = _package_edges(Code(t))
    declared = t.part.select(F.col("p_brand").alias("name"))
    return P.dependencies_named(declared, e, "PKG/service").unionByName(P.dependencies_named(declared, e, "BRAND#12"))


@query(
    f"""WITH {CALLS}, h AS (SELECT min(id) AS id FROM symbols WHERE name = (SELECT min(name) FROM symbols WHERE id IN (SELECT dst FROM calls)))
 SELECT 'in' AS direction, src AS other FROM calls, h WHERE dst = h.id UNION ALL SELECT 'out', dst FROM calls, h WHERE src = h.id"""
)
def graph_call(t: Tables) -> DataFrame:
    """Around the first symbol with the least name that is called."""
    c = Code(t)
    calls, s = c.calls(), c.symbols()
    name = s.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").agg(F.min("name")).first()[0]
    return P.calls_around(s, calls, name or "none")


@query(
    f"""WITH {REFS}, {_IMPLEMENTS} SELECT 'duplicate_definition' AS issue, pkg || '.' || name AS id FROM (SELECT pkg, name FROM symbols UNION ALL SELECT pkg, name FROM symbols WHERE n % 40 = 0) GROUP BY pkg, name HAVING count(*) > 1
 UNION ALL SELECT 'unresolved_reference', id FROM refs WHERE dst NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'visibility_violation', r.id FROM refs r JOIN symbols s ON s.id = r.dst WHERE r.src_pkg <> s.pkg AND NOT s.exported AND s.n % 40 <> 0
 UNION ALL SELECT DISTINCT 'undeclared_implementor', type_id FROM imp WHERE type_id NOT IN (SELECT id FROM symbols)"""
)
def validate_semantics(t: Tables) -> DataFrame:
    """Every fortieth symbol is declared twice; uses of those aren't looked at for visibility."""
    c = Code(t)
    s, few = c.symbols(), c.symbols().where("n % 40 = 0")
    r = c.references().select("id", "dst", "src_pkg")
    twice = P.validate_semantics(s.unionByName(few), r.limit(0), _implements(c).limit(0))
    uses = r.join(few.select(F.col("id").alias("dst")), "dst", "left_anti")
    return twice.unionByName(P.validate_semantics(s, uses, _implements(c)))


@query(
    f"""WITH {REFS}, {_FILE_DEPS} SELECT 'missing_target' AS issue, src || '->' || dst AS id FROM fd WHERE dst NOT IN (SELECT file FROM symbols WHERE n % 3 <> 0) UNION ALL SELECT 'incompatible_versions', p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_size % 4) > 1
 UNION ALL SELECT DISTINCT 'unknown_repository', p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0)"""
)
def validate_workspace(t: Tables) -> DataFrame:
    c = Code(t)
    files = c.symbols().where("n % 3 <> 0").select("file")
    shared = t.part.select(F.col("p_type").alias("dependency"), F.col("p_brand").alias("consumer"), (F.col("p_size") % 4).cast("string").alias("version"))
    repositories = t.part.where("p_size % 2 = 0 and p_partkey % 3 = 0").select(F.col("p_brand").alias("name"))
    return P.validate_workspace(N.file_dependencies(c.references(), c.symbols()), files, shared, repositories)


@query(
    f"""WITH {REFS}, q AS (SELECT name AS request FROM symbols UNION SELECT 'gone ' || p_brand FROM part), n AS (SELECT name, count(*) AS n FROM symbols GROUP BY 1)
 SELECT CASE WHEN n.n IS NULL THEN 'missing_target' ELSE 'ambiguous_target' END AS issue, request AS id FROM q LEFT JOIN n ON n.name = request WHERE n.n IS NULL OR n.n > 1
 UNION ALL SELECT 'broken_reference', id FROM refs WHERE state = 'broken' OR dst = '' UNION ALL SELECT 'duplicate_usage', dst || '<-' || src || '<-' || line FROM refs WHERE dst <> '' GROUP BY dst, src, line HAVING count(*) > 1"""
)
def validate_navigation(t: Tables) -> DataFrame:
    c = Code(t)
    s, r = c.symbols(), c.references()
    asked = s.select(F.col("name").alias("request")).unionByName(t.part.select(F.concat(F.lit("gone "), "p_brand").alias("request")))
    usages = r.where("dst <> ''").select(F.col("dst").alias("symbol"), F.col("src").alias("source"), F.col("line").cast("string").alias("place"))
    return P.validate_navigation(N.definitions(asked, s), r, usages)


@query(f"WITH {REFS} SELECT dst_pkg AS dependency, count(DISTINCT split_part(src_pkg, '/', 1)) AS repositories, count(DISTINCT src_pkg) AS packages FROM refs WHERE dst <> '' AND dst_pkg <> split_part(src_pkg, '/', 1) GROUP BY 1 HAVING count(DISTINCT split_part(src_pkg, '/', 1)) > 1")
def shared_dependencies(t: Tables) -> DataFrame:
    c = Code(t)
    uses = c.references().where("dst <> ''").select(F.col("src_pkg").alias("pkg"), F.col("dst_pkg").alias("dependency"))
    repositories = c.symbols().select("pkg", X.first_segment(F.col("pkg")).alias("repository")).distinct()
    return P.shared_dependencies(uses, repositories)


@query("SELECT user_id AS plugin, count(*) FILTER (event_type = 'error') - CASE WHEN arg_min(event_type, (ts, event_id)) = 'error' THEN 1 ELSE 0 END AS crashes FROM events GROUP BY 1")
def crash_counts(t: Tables) -> DataFrame:
    return P.crash_counts(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(
    f"""WITH {CALLS}, x AS (SELECT s.id, CASE WHEN EXISTS (SELECT 1 FROM calls c JOIN symbols y ON y.id = c.src WHERE c.dst = s.id AND y.pkg <> s.pkg) THEN 'breaking' WHEN s.id IN (SELECT dst FROM calls) THEN 'potentially_breaking' ELSE 'safe' END AS classification,
 (CASE WHEN name NOT IN ('main', 'init') AND NOT ends_with(file, '_test.go') AND NOT (exported AND NOT contains(pkg, 'internal')) AND kind <> 'interface' AND {_UNUSED} THEN 1 ELSE 0 END + CASE WHEN exported AND contains(pkg, 'internal') AND NOT ends_with(file, '_test.go') AND {_UNUSED} THEN 1 ELSE 0 END)::BIGINT AS findings,
 CASE WHEN exported AND NOT ends_with(file, '_test.go') AND pkg <> 'main' AND NOT starts_with(pkg, 'cmd') AND s.id NOT IN (SELECT dst FROM calls) THEN 1 ELSE 0 END::BIGINT AS recommendations FROM symbols s) SELECT * FROM x"""
)
def reasoning_report(t: Tables) -> DataFrame:
    """Removal, dead code, unused exports and the advice to unexport, for every symbol."""
    c = Code(t)
    s, r, calls = c.symbols(), c.references(), c.calls()
    findings = A.dead_code(s, r, calls).unionByName(A.unused_exports(s, r))
    advice = A.recommendations(s.select(F.col("pkg").alias("id")).distinct(), calls.limit(0), s, calls, s.select("id")).where("rule = 'unexport'")
    return P.reasoning(s, M.removals(s, calls, F.col("pkg")), findings, advice)


_DEPS = "dp AS (SELECT DISTINCT 'p' || (l_partkey % 40) AS src, 'p' || (l_suppkey % 40) AS dst FROM lineitem WHERE l_orderkey % 11 = 0 AND l_linenumber <= 2 AND l_partkey % 40 <> l_suppkey % 40)"


@query(
    f"""WITH RECURSIVE {_DEPS}, p(first, node, path) AS (SELECT src, dst, [src] FROM dp WHERE dst >= src UNION ALL SELECT first, dst, list_append(path, node) FROM p JOIN dp ON node = src WHERE node <> first AND len(path) < 3 AND dst >= first AND NOT list_contains(path, node))
 SELECT array_to_string(list_append(path, first), ' -> ') AS cycle FROM p WHERE node = first"""
)
def plugin_cycles(t: Tables) -> DataFrame:
    """Cycles of three plugins at most, as closed paths."""
    number = lambda c: F.concat(F.lit("p"), (F.col(c) % 40).cast("string"))
    d = t.lineitem.where("l_orderkey % 11 = 0 and l_linenumber <= 2 and l_partkey % 40 <> l_suppkey % 40").select(number("l_partkey").alias("src"), number("l_suppkey").alias("dst")).distinct()
    got = G.cycles(d.withColumn("kind", F.lit("depends_on")).withColumn("id", F.concat_ws("->", "src", "dst")), 3)
    return got.select(X.canonical_cycle(F.col("cycle")).alias("cycle"))


@query("SELECT p_brand AS id, arg_max((p_size % 4) || '.' || (p_partkey % 7) || '.' || (p_size % 3), (p_size % 4, p_partkey % 7, p_size % 3)) AS version FROM part GROUP BY 1")
def newest_versions(t: Tables) -> DataFrame:
    return P.newest(t.part.select(F.col("p_brand").alias("id"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_partkey") % 7, F.col("p_size") % 3).alias("version")))


@query(f"WITH {PATHS} SELECT path, CASE WHEN count(*) > 1 THEN 'repeated' ELSE 'once' END AS state, min(id) AS first FROM paths GROUP BY 1")
def repeated_paths(t: Tables) -> DataFrame:
    got = Code(t).paths().groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return got.select("path", F.when(F.col("n") > 1, "repeated").otherwise("once").alias("state"), "first")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1)")
def changed_files(t: Tables) -> DataFrame:
    """Documents whose hash isn't in the snapshot of those labelled good."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("path"), C.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    good = t.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("path")).distinct()
    got = S.changed(docs, docs.join(good, "path", "left_semi"))
    return got.select(F.col("path").cast("long").alias("doc_id"), "content_hash")




_SRC = f"""{SYMBOLS}, g AS (SELECT n, pkg, pkg || '/g' || n || '.go' AS path, pkg || '.(*T' || (n % 9) || ').M' || n AS m FROM symbols), h AS (SELECT pkg, n % 5 AS k FROM g GROUP BY 1, 2)"""


def _go_files(t: Tables) -> DataFrame:
    """A source for each symbol: a method that calls a helper, an import, itself and a literal, and constants; every fifth declares the helper.

    A file of a few MB names a million sources, so they are dealt over all tasks before they are read.
    """
    n = F.col("n").cast("string")
    k = lambda m: (F.col("n") % m).cast("string")
    text = F.concat(
        F.lit('// file\npackage p\n\nimport (\n\t"fmt"\n\tsvc "pkg/service"\n)\n\n// M'), n, F.lit(" runs. TODO: less\nfunc (r *T"), k(9), F.lit(") M"), n,
        F.lit("(a int, b ...string) (int, error) {\n\tif a > 1 { // {\n\t\thelper"), k(5), F.lit("(a)\n\t}\n\tsvc.Execute(len(b))\n\tx := &Rec"), k(3),
        F.lit('{A: "f(x) {"}\n\tr.M'), n, F.lit("(x)\n\treturn 1, nil\n}\n\nconst (\n\tC"), n, F.lit(" = iota\n\td"), n, F.lit(" int = 2\n)\n"),
        F.when(F.col("n") % 25 < 5, F.concat(F.lit("\nfunc helper"), k(5), F.lit("(n int) { fmt.Println(n) }\n"))).otherwise(""),
    )
    return Code(t).symbols().select("n", "pkg").repartition(t.tasks(), "n").select(F.concat("pkg", F.lit("/g"), n, F.lit(".go")).alias("path"), text.alias("content"))


@query(
    f"""WITH {_SRC} SELECT file_path, kind, name, id, line FROM (SELECT path AS file_path, 'method' AS kind, 'M' || n AS name, m AS id, 10 AS line FROM g UNION ALL SELECT path, 'constant', 'C' || n, pkg || '.C' || n, 21 FROM g
 UNION ALL SELECT path, 'constant', 'd' || n, pkg || '.d' || n, 22 FROM g UNION ALL SELECT path, 'function', 'helper' || (n % 5), pkg || '.helper' || (n % 5), 25 FROM g WHERE n % 25 < 5 UNION ALL SELECT path, 'todo', 'TODO: less', NULL, 9 FROM g)"""
)
def go_declarations(t: Tables) -> DataFrame:
    d = GO.declarations(_go_files(t))
    return d.where("what in ('symbol', 'note')").select("file_path", "kind", "name", "id", "line")


@query(
    f"""WITH {_SRC}, hp AS (SELECT DISTINCT pkg || '.helper' || (n % 5) AS id FROM g WHERE n % 25 < 5), r AS (SELECT m AS source, pkg || '.T' || (n % 9) AS target, 'type_reference' AS kind, 10 AS line FROM g
 UNION ALL SELECT m, pkg || '.helper' || (n % 5), 'function_reference', 12 FROM g UNION ALL SELECT m, 'pkg/service.Execute', 'function_reference', 14 FROM g UNION ALL SELECT m, pkg || '.Rec' || (n % 3), 'struct_reference', 15 FROM g
 UNION ALL SELECT m, m, 'method_reference', 16 FROM g UNION ALL SELECT pkg || '.helper' || (n % 5), 'fmt.Println', 'function_reference', 25 FROM g WHERE n % 25 < 5)
 SELECT source, target, kind, line, CASE WHEN target IN (SELECT m FROM g) OR target IN (SELECT id FROM hp) THEN 'resolved' ELSE 'unresolved_external' END AS state FROM r"""
)
def go_references(t: Tables) -> DataFrame:
    return GO.resolved(GO.declarations(_go_files(t))).select("source", "target", "kind", "line", "state")


@query(
    f"""WITH {_SRC}, c AS (SELECT m AS src, pkg || '.helper' || (n % 5) AS dst FROM g UNION ALL SELECT m, 'pkg/service.Execute' FROM g UNION ALL SELECT m, m FROM g UNION ALL SELECT pkg || '.helper' || (n % 5), 'fmt.Println' FROM g WHERE n % 25 < 5)
 SELECT DISTINCT src, dst, CASE WHEN src = dst THEN 'recursive' ELSE 'calls' END AS kind FROM c"""
)
def go_calls(t: Tables) -> DataFrame:
    return GO.call_edges(GO.resolved(GO.declarations(_go_files(t))))


@query(
    f"""WITH {_SRC}, hp AS (SELECT DISTINCT pkg || '.helper' || (n % 5) AS id FROM g WHERE n % 25 < 5), r AS (SELECT n, m AS source, pkg || '.T' || (n % 9) AS target, 'type_reference' AS kind, 10 AS line FROM g
 UNION ALL SELECT n, m, pkg || '.helper' || (n % 5), 'function_reference', 12 FROM g UNION ALL SELECT n, m, 'pkg/service.Execute', 'function_reference', 14 FROM g UNION ALL SELECT n, m, pkg || '.Rec' || (n % 3), 'struct_reference', 15 FROM g
 UNION ALL SELECT n, m, m, 'method_reference', 16 FROM g UNION ALL SELECT n, pkg || '.helper' || (n % 5), 'fmt.Println', 'function_reference', 25 FROM g WHERE n % 25 < 5)
 SELECT source, target, kind, line, CASE WHEN target IN (SELECT m FROM g) OR target IN (SELECT id FROM hp) THEN 'resolved' ELSE 'unresolved_external' END AS state, n % 10 IN (3, 7) AS parsed FROM r"""
)
def go_incremental(t: Tables) -> DataFrame:
    """The sources after a run without those whose number ends in 3, with an empty one for a 7, and with one more, since deleted, for a 5."""
    files = _go_files(t)
    last = F.regexp_extract("path", r"(\d)\.go$", 1)
    before = files.where(last != "3").withColumn("content", F.when(last == "7", "package p\n").otherwise(F.col("content")))
    gone = files.where(last == "5").select(F.regexp_replace("path", r"\.go$", "_old.go").alias("path"), "content")
    now, parsed = GI.update(files, GI.full(before.unionByName(gone)))
    new = parsed.select(F.col("path").alias("file_path"), F.lit(True).alias("parsed"))
    return now.references.join(new, "file_path", "left").select("source", "target", "kind", "line", "state", F.coalesce("parsed", F.lit(False)).alias("parsed"))


# Calls on variables, fields and results


def _go_typed_files(t: Tables) -> DataFrame:
    """Types of an own number for each symbol, and calls that need the types of variables, fields, results and embedded types; dealt as above."""
    n, half = F.col("n").cast("string"), F.floor(F.col("n") / 2).cast("string")
    text = """package p

import o "{other}"

type Own# struct {
	inner *In#
	*Emb#
}
type In# struct{}
type Emb# struct{}

func (i *In#) Run#() (*Emb#, error) { return nil, nil }
func (e Emb#) Stop#() error { return nil }
func New#() (*Own#, error) { return nil, nil }

func use#(p *Own#, q int) {
	x, err := New#()
	x.Stop#()
	p.inner.Run#()
	y := p.inner
	for _, z := range []*In#{y} {
		z.Run#()
	}
	if w, bad := y.Run#(); bad != nil {
		w.Stop#()
		y := w
		y.Stop#()
	}
	y.Run#()
	q.Stop#()
	err.Error()
	v, _ := o.New@()
	v.Stop@()
}
"""
    s = Code(t).symbols()
    other = dealt(s.select(F.col("n").alias("_half"), F.col("pkg").alias("other")))
    s = s.withColumn("_half", F.floor(F.col("n") / 2).cast("long")).join(other, "_half", "left").select("n", "pkg", F.coalesce("other", F.lit("none")).alias("other"))
    s = s.repartition(t.tasks(), "n")
    made = F.replace(F.replace(F.replace(F.lit(text), F.lit("#"), n), F.lit("@"), half), F.lit("{other}"), F.col("other"))
    return s.select(F.concat("pkg", F.lit("/u"), n, F.lit(".go")).alias("path"), made.alias("content"))


_TYPED = f"""{SYMBOLS}, g AS (SELECT s.n, s.pkg || '.use' || s.n AS source, s.pkg || '.(*In' || s.n || ').Run' || s.n AS run, s.pkg || '.(Emb' || s.n || ').Stop' || s.n AS stop, s.pkg || '.New' || s.n AS made,
 coalesce(o.pkg, 'none') || '.New' || (s.n // 2) AS omade, o.pkg || '.(Emb' || o.n || ').Stop' || o.n AS ostop, 'Stop' || s.n AS m, 'Stop' || (s.n // 2) AS om FROM symbols s LEFT JOIN symbols o ON o.n = s.n // 2),
 typed AS (SELECT source, line, target, state FROM (SELECT source, UNNEST([17, 18, 19, 22, 24, 25, 27, 29, 30, 31, 32, 33]) AS line, UNNEST([made, stop, run, run, run, stop, stop, run, 'q.' || m, 'err.Error', omade, coalesce(ostop, 'v.' || om)]) AS target,
 UNNEST(['resolved', 'resolved', 'resolved', 'resolved', 'resolved', 'resolved', 'resolved', 'resolved', 'unresolved_external', 'unresolved_external', CASE WHEN ostop IS NULL THEN 'unresolved_external' ELSE 'resolved' END, CASE WHEN ostop IS NULL THEN 'unresolved_external' ELSE 'resolved' END]) AS state FROM g))"""


@query(f"WITH {_TYPED} SELECT source, target, line::INT AS line, state FROM typed")
def go_receiver_calls(t: Tables) -> DataFrame:
    """Calls through variables, parameters, fields, results, embedded types and other packages."""
    r = GO.resolved(GO.declarations(_go_typed_files(t)))
    return r.where("kind in ('method_reference', 'function_reference')").select("source", "target", "line", "state")


@query(f"""WITH {SYMBOLS}, s AS (SELECT pkg || '/u' || n || '.go' AS file, UNNEST([12, 13, 14, 16, 21, 24]) AS line, UNNEST([12, 13, 14, 34, 23, 28]) AS end_line, UNNEST([NULL, NULL, NULL, NULL, 16, 16]) AS parent FROM symbols)
 SELECT file, line::INT AS line, end_line::INT AS end_line, coalesce(parent, 0)::INT AS parent_line FROM s""")
def go_scopes(t: Tables) -> DataFrame:
    """The blocks of bodies, each with the first line of the block around it; 0 at the top."""
    found = GO.declarations(_go_typed_files(t)).where("what = 'scope'").select("file_path", "at", "until", "line", "end_line")
    spans = GO.cut(found).select(F.concat_ws(":", "file_path", "at").alias("span_id"), "file_path", F.col("at").alias("low"), F.col("until").alias("high"), "line", "end_line")
    around = IV.parents(spans, ["file_path"])
    lines = spans.select(F.col("span_id").alias("parent_id"), F.col("line").alias("parent_line"))
    j = spans.join(around, "span_id").join(lines, "parent_id", "left")
    return j.select(F.col("file_path").alias("file"), "line", "end_line", F.coalesce("parent_line", F.lit(0)).alias("parent_line"))


# A tree that grows with the tables: each part under the one of half its number


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    edges = t.part.where("p_partkey > 1").select(name(n).alias("src"), name(F.floor(n / 2)).alias("dst"), F.lit("belongs_to").alias("kind"))
    return t.part.select(name(n).alias("id"), n.alias("n")), edges.withColumn("id", F.concat_ws("->", "src", "dst"))


@query("SELECT 'p' || p_partkey AS id, length(bin(p_partkey))::INT - 1 AS level FROM part")
def tree_levels(t: Tables) -> DataFrame:
    nodes, edges = _tree(t)
    return G.topological_levels(nodes, edges)


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 2 AS d FROM part WHERE p_partkey > 1), r(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT d FROM e) UNION SELECT d, depth + 1 FROM r JOIN e ON s = id)
 SELECT max(depth)::INT AS max_depth FROM r"""
)
def tree_depth(t: Tables) -> DataFrame:
    return G.max_depth(*_tree(t))


@query("WITH RECURSIVE r(id, top, n) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey > 1 UNION ALL SELECT id, top // 2, n + 1 FROM r WHERE top > 1) SELECT 'p' || id AS id, 'p1' AS root, max(n)::INT + 1 AS length FROM r GROUP BY 1")
def tree_owners(t: Tables) -> DataFrame:
    return PT.owners(_tree(t)[1]).withColumn("length", F.col("length").cast("int"))


@query("WITH RECURSIVE r(id, depth) AS (SELECT 1, 0 UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = id AND p_partkey > 1 WHERE depth < 9) SELECT 'p' || id AS id, depth::INT AS depth FROM r")
def tree_below(t: Tables) -> DataFrame:
    nodes, edges = _tree(t)
    return G.traverse(nodes, edges, "p1", "inbound", 9)[0].select("id", "depth")


# Roles of functions, scope of a change, audit events, evolution


@query(
    f"""WITH RECURSIVE {CALLS}, fn AS (SELECT id FROM symbols WHERE kind IN ('function', 'method') UNION SELECT src FROM calls UNION SELECT dst FROM calls), en AS (SELECT id FROM fn WHERE n_is_init(id)),
 rc(id) AS (SELECT id FROM en UNION SELECT dst FROM rc JOIN calls ON src = id), t AS (SELECT src, dst FROM calls WHERE src <> dst AND src IN (SELECT dst FROM calls) AND dst IN (SELECT src FROM calls)),
 pr(seed, id) AS (SELECT src, dst FROM t UNION SELECT seed, dst FROM pr JOIN t ON src = id)
 SELECT id, n_is_init(id) AS entry, id NOT IN (SELECT src FROM calls) AS leaf, CASE WHEN id IN (SELECT id FROM pr WHERE seed = id) THEN 'mutual' WHEN id IN (SELECT src FROM calls WHERE src = dst) THEN 'direct' ELSE 'none' END AS recursion,
 CASE WHEN NOT EXISTS (SELECT 1 FROM en) THEN 'unknown' WHEN id IN (SELECT id FROM rc) THEN 'confirmed' WHEN id NOT IN (SELECT dst FROM calls) AND (NOT regexp_matches(regexp_extract(id, '([^.]*)$', 1), '^[A-Z]') OR starts_with(id, 'main.') OR NOT contains(id, '/')) THEN 'unreachable' ELSE 'unknown' END AS reach FROM fn""".replace(
        "n_is_init(id)", "(ends_with(id, '.init') OR ends_with(id, 'main.main') OR id IN ('main', 'init'))"
    )
)
def function_roles(t: Tables) -> DataFrame:
    """Of calls and their callers; no symbol of the tables is named init alone, so nothing is confirmed."""
    c = Code(t)
    return G.function_roles(c.symbols().where("kind in ('function', 'method')"), c.calls())


@query("WITH x AS (SELECT count(DISTINCT p_name) FILTER (p_size % 2 = 0) AS symbols, count(DISTINCT p_brand) FILTER (p_size % 2 = 1) AS packages FROM part) SELECT symbols, packages, TRUE AS cross_module, CASE WHEN packages >= 5 OR symbols >= 20 THEN 'repository' ELSE 'module' END AS scope FROM x")
def impact_scope(t: Tables) -> DataFrame:
    """A change that touches all parts: even ones as symbols by name, odd ones as packages by brand."""
    even = F.col("p_size") % 2 == 0
    touched = t.part.select(F.when(even, F.col("p_name")).otherwise(F.col("p_brand")).alias("id"), F.when(even, "symbol").otherwise("package").alias("type"), F.col("p_brand").alias("pkg"))
    return G.impact_scope(touched, "elsewhere")


@query(
    """SELECT event_id, sha256(event_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z:org:' || user_id || ':user:' || event_type || ':' || props || '::1.0.0:prod:allow:ok::' || (event_id % 7) || ':p' || event_id) AS hash FROM events"""
)
def audit_hashes(t: Tables) -> DataFrame:
    c, v = F.col, F.lit
    e = t.events.select(
        "event_id", c("event_id").alias("sequence"), c("ts").alias("timestamp"), v("org").alias("organization_id"), c("user_id").alias("actor_id"), v("user").alias("actor_type"), c("event_type").alias("action"),
        c("props").alias("target"), v(None).cast("string").alias("plugin_id"), v("1.0.0").alias("version"), v("prod").alias("deployment_target"), v("allow").alias("policy_result"), v("ok").alias("outcome"),
        v("").alias("reason"), (c("event_id") % 7).alias("correlation_id"),
    )
    return e.select("event_id", E.audit_hash(F.concat(v("p"), "event_id")).alias("hash"))


@query("SELECT o_custkey AS ordinal, count(*) FILTER (o_orderstatus = 'O') AS added, count(*) FILTER (o_orderstatus = 'F') AS removed, (count(*) FILTER (o_orderstatus = 'O') > 5 OR count(*) FILTER (o_orderstatus = 'F') > 5) AS structural, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 5 OR count(*) FILTER (o_orderstatus = 'F') > 5 THEN max(o_orderpriority) END AS note FROM orders GROUP BY 1")
def evolution_points(t: Tables) -> DataFrame:
    """Each customer's orders as a commit."""
    commits = t.orders.groupBy(F.col("o_custkey").alias("ordinal")).agg(
        F.min("o_orderdate").alias("ts"), F.count_if(F.col("o_orderstatus") == "O").alias("added"), F.count_if(F.col("o_orderstatus") == "F").alias("removed"), F.max("o_orderpriority").alias("message")
    )
    return K.evolution(commits).drop("ts")


@query("SELECT count(*) AS commits, 300.0::DOUBLE / count(*) AS file_rate, 12.0::DOUBLE / count(*) AS package_rate FROM orders")
def growth_rates(t: Tables) -> DataFrame:
    return K.growth(t.orders, 300, 12)


@query(
    """WITH r AS (SELECT *, count(*) FILTER (event_type = 'error') OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, CASE WHEN max(CASE WHEN c >= 30 OR (event_type = 'purchase' AND value > 95) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'quarantine' WHEN event_type = 'signup' THEN 'warn' ELSE 'none' END AS action FROM r"""
)
def rejected_actions(t: Tables) -> DataFrame:
    """A rejected verification quarantines as an escape does."""
    kind = F.col("event_type")
    got = E.recovery_states(t.events, "user_id", kind == "error", F.lit(False), kind == "signup", F.lit(False), 30, 5, (kind == "purchase") & (F.col("value") > 95))
    return got.select("event_id", "action")


@query(
    """WITH m AS (SELECT p_size % 3 AS folder_order, 'd/' || p_partkey || '/plugin.json' AS path, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'plug' || (p_partkey % 90) END AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 10 <> 0 THEN '1.' || p_size END AS version FROM part)
 SELECT id, name, version, path, CASE WHEN id IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY id ORDER BY folder_order, path) = 1 THEN 'found' ELSE 'duplicate' END AS state FROM m"""
)
def plugin_manifests(t: Tables) -> DataFrame:
    """Manifests of ninety plugins in three folders; every tenth isn't JSON."""
    n = F.col("p_partkey")
    text = F.to_json(F.struct(F.concat(F.lit("plug"), n % 90).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("1."), "p_size").alias("version")))
    files = t.part.select((F.col("p_size") % 3).alias("folder_order"), F.concat(F.lit("d/"), n, F.lit("/plugin.json")).alias("path"), F.when(n % 10 == 0, "{no json").otherwise(text).alias("content"))
    return RP.manifests(files)
