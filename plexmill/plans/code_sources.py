"""Queries of manifests, imports, types, scopes, aliases and scores, each beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import version as V
from ..operators import audit as A
from ..operators import lookup as L
from ..operators import model as M
from ..operators import resolve as J
from ..operators import rules as R
from ..operators.rounds import dealt
from ..sources import manifests as MF
from . import code as S_
from .code import COMMS, PATHS, REFS, SYMBOLS, Code
from .queries import query
from .relations import Tables, entity_id

_MANIFESTS = ["go.mod", "package.json", "Cargo.toml", "pom.xml", "build.gradle", "requirements.txt", "composer.json"]


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    f"""WITH m AS (SELECT p_partkey AS n, 'd' || p_partkey || '/' || {S_._list(_MANIFESTS)}[(p_partkey % 7 + 1)::INT] AS path, p_partkey % 7 AS k, p_size AS v FROM part)
 SELECT path, 'example.org/a/m' || n AS name, 'v1.' || v || '.0' AS version, 'go' AS ecosystem, 'runtime' AS dep_type FROM m WHERE k = 0 UNION ALL SELECT path, 'example.org/b/m' || n, 'v0.' || v || '.1', 'go', 'indirect' FROM m WHERE k = 0
 UNION ALL SELECT path, 'left' || n, '^' || v || '.0.0', 'npm', 'runtime' FROM m WHERE k = 1 UNION ALL SELECT path, 'dev' || n, v::VARCHAR, 'npm', 'dev' FROM m WHERE k = 1
 UNION ALL SELECT path, 'serde' || n, v || '.0', 'cargo', 'runtime' FROM m WHERE k = 2 UNION ALL SELECT path, 'rand' || n, '0.' || v, 'cargo', 'dev' FROM m WHERE k = 2
 UNION ALL SELECT path, 'g.' || n || ':a', v::VARCHAR, 'maven', CASE WHEN v % 2 = 0 THEN 'dev' ELSE 'runtime' END FROM m WHERE k = 3
 UNION ALL SELECT path, 'g:a' || n, v || '.0', 'gradle', 'runtime' FROM m WHERE k = 4 UNION ALL SELECT path, 'g:t' || n, '2.' || v, 'gradle', 'dev' FROM m WHERE k = 4
 UNION ALL SELECT path, 'num' || n, '==' || v || '.2', 'pypi', 'runtime' FROM m WHERE k = 5 UNION ALL SELECT path, 'flask' || n, '>=' || v, 'pypi', 'runtime' FROM m WHERE k = 5 UNION ALL SELECT path, 'plain' || n, '', 'pypi', 'runtime' FROM m WHERE k = 5
 UNION ALL SELECT path, 'v/p' || n, '~' || v, 'composer', 'runtime' FROM m WHERE k = 6 UNION ALL SELECT path, 'v/d' || n, '*', 'composer', 'dev' FROM m WHERE k = 6"""
)
def manifest_dependencies(t: Tables) -> DataFrame:
    """A manifest of one of seven kinds for each part."""
    n, v = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    texts = [
        _text("module x\n\ngo 1.21\n\nrequire (\n\texample.org/a/m", n, " v1.", v, ".0\n\texample.org/b/m", n, " v0.", v, ".1 // indirect\n)\n"),
        _text('{"name": "x", "dependencies": {"left', n, '": "^', v, '.0.0"}, "devDependencies": {"dev', n, '": "', v, '"}}'),
        _text('[package]\nname = "z"\n[dependencies]\nserde', n, ' = "', v, '.0"\n[dev-dependencies]\nrand', n, ' = { version = "0.', v, '", features = ["a"] }\n'),
        _text("<project><dependencies><dependency><groupId>g.", n, "</groupId><artifactId>a</artifactId><version>", v, "</version>", F.when(F.col("p_size") % 2 == 0, "<scope>test</scope>").otherwise(""), "</dependency></dependencies></project>"),
        _text("dependencies {\n  implementation 'g:a", n, ":", v, ".0'\n  testImplementation(\"g:t", n, ":2.", v, '")\n}\n'),
        _text("# c\nnum", n, "==", v, ".2\nflask", n, "[async]>=", v, " # web\nplain", n, "\n"),
        _text('{"require": {"v/p', n, '": "~', v, '"}, "require-dev": {"v/d', n, '": "*"}}'),
    ]
    text = F.get(F.array(*texts), (F.col("p_partkey") % 7).cast("int"))
    files = t.part.select(F.concat(F.lit("d"), n, F.lit("/"), S_._at(_MANIFESTS, F.col("p_partkey") % 7)).alias("path"), text.alias("content"))
    return MF.dependencies(files)


@query(
    """WITH f AS (SELECT p_partkey AS n, p_partkey % 3 AS k, p_size AS v FROM part) SELECT 's' || n || '.go' AS path, 'pkg/a' || v AS target FROM f WHERE k = 0 UNION ALL SELECT 's' || n || '.go', 'fmt' FROM f WHERE k = 0
 UNION ALL SELECT 's' || n || '.ts', 'lib' || v FROM f WHERE k = 1 UNION ALL SELECT 's' || n || '.ts', 'other' || n FROM f WHERE k = 1 UNION ALL SELECT 's' || n || '.py', 'os.path' FROM f WHERE k = 2 UNION ALL SELECT 's' || n || '.py', 'mod' || v FROM f WHERE k = 2"""
)
def source_imports(t: Tables) -> DataFrame:
    n, v = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    texts = [
        _text('package p\n\nimport (\n\t"fmt"\n\tx "pkg/a', v, '"\n)\n'), _text("import { a } from 'lib", v, "';\nconst b = require('other", n, "');\n"), _text("from os.path import join\nimport mod", v, "\n"),
    ]
    files = t.part.select(
        F.concat(F.lit("s"), n, S_._at([".go", ".ts", ".py"], F.col("p_partkey") % 3)).alias("path"), F.get(F.array(*texts), (F.col("p_partkey") % 3).cast("int")).alias("content")
    )
    return MF.imports(files)


_EXPR = ["*{}", "[]{}", "{}", "math.{}", "int", "map[string]int", "Missing", "[3]*{}"]


@query(
    f"""WITH {SYMBOLS}, ty AS (SELECT id, 'Ty' || (n % 41) AS name, pkg, regexp_extract(pkg, '([^/]*)$', 1) AS base FROM symbols WHERE kind = 'struct'), u AS (SELECT n AS use_id, n % 8 AS k, pkg, 'Ty' || (n % 60) AS name FROM symbols),
 r AS (SELECT u.*, (SELECT min(id) FROM ty WHERE ty.name = u.name AND ty.pkg = u.pkg) AS own, (SELECT min(id) FROM ty WHERE ty.name = u.name AND ty.base = 'math') AS q, (SELECT count(*) FROM ty WHERE ty.name = u.name) AS n, (SELECT min(id) FROM ty WHERE ty.name = u.name) AS one FROM u)
 SELECT use_id, CASE WHEN k IN (4, 5) THEN 'resolved' WHEN k = 6 THEN 'unresolved' WHEN k = 3 THEN CASE WHEN q IS NOT NULL THEN 'resolved' ELSE 'unresolved' END WHEN own IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state,
 CASE WHEN k IN (4, 5, 6) THEN NULL WHEN k = 3 THEN q WHEN own IS NOT NULL THEN own WHEN n = 1 THEN one END AS type_id FROM r"""
)
def resolve_types(t: Tables) -> DataFrame:
    s = Code(t).symbols()
    types = s.where("kind = 'struct'").select("id", F.concat(F.lit("Ty"), F.col("n") % 41).alias("name"), F.col("pkg").alias("package"), F.element_at(F.split("pkg", "/"), -1).alias("package_name"))
    name = F.concat(F.lit("Ty"), F.col("n") % 60)
    expr = F.get(F.array(*[F.concat(F.lit(a), name, F.lit(b)) if "{}" in e else F.lit(e) for e in _EXPR for a, _, b in [e.partition("{}")]]), (F.col("n") % 8).cast("int"))
    return M.resolve_types(s.select(F.col("n").alias("use_id"), expr.alias("expr"), F.col("pkg").alias("package")), types).select("use_id", "state", "type_id")


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 100 = 0 THEN p_partkey + 1 WHEN p_partkey % 100 = 1 AND p_partkey > 1 THEN p_partkey - 1 ELSE p_partkey // 2 END AS target FROM part WHERE p_partkey > 1),
 r(id, node, path) AS (SELECT id, target, [id, target] FROM a UNION ALL SELECT r.id, a.target, list_append(path, a.target) FROM r JOIN a ON a.id = r.node WHERE NOT list_contains(list_slice(path, 1, len(path) - 1), r.node)),
 l AS (SELECT id, max(len(path)) AS n, bool_or(list_contains(list_slice(path, 1, len(path) - 1), node)) AS cyclic FROM r GROUP BY 1) SELECT l.id, cyclic AS is_cyclic, (SELECT count(*) FROM a WHERE a.id = r.node) = 0 AS ends FROM l JOIN r ON r.id = l.id AND len(r.path) = l.n"""
)
def alias_chains(t: Tables) -> DataFrame:
    """Each part is an alias of the one of half its number; pairs at the hundreds name each other."""
    n = F.col("p_partkey")
    target = F.when(n % 100 == 0, n + 1).when((n % 100 == 1) & (n > 1), n - 1).otherwise(F.floor(n / 2).cast("long"))
    aliases = t.part.where("p_partkey > 1").select(n.alias("id"), target.alias("target"))
    got = M.alias_ends(aliases).join(dealt(aliases.select(F.col("id").alias("end"), F.lit(False).alias("_more"))), "end", "left")
    return got.select("id", "is_cyclic", F.coalesce("_more", F.lit(True)).alias("ends"))


@query(
    """WITH RECURSIVE d AS (SELECT p_partkey AS id, p_partkey // 3 AS scope, 'v' || (p_partkey % 11) AS name FROM part WHERE p_partkey % 4 <> 0), up(use_id, name, scope, level) AS (SELECT p_partkey, 'v' || (p_size % 12), p_partkey, 0 FROM part UNION ALL SELECT use_id, name, scope // 2, level + 1 FROM up WHERE scope > 1),
 h AS (SELECT use_id, level, count(*) AS n, min(d.id) AS declaration FROM up JOIN d ON d.scope = up.scope AND d.name = up.name GROUP BY 1, 2), f AS (SELECT use_id, arg_min(n, level) AS n, arg_min(declaration, level) AS declaration FROM h GROUP BY 1)
 SELECT p_partkey AS use_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN 'd' || declaration END AS declaration FROM part LEFT JOIN f ON use_id = p_partkey"""
)
def resolve_scopes(t: Tables) -> DataFrame:
    """Scopes nest as a tree of halves; names are looked for outwards."""
    n = F.col("p_partkey")
    scopes = t.part.select(n.alias("scope_id"), F.when(n > 1, F.floor(n / 2).cast("long")).alias("parent_id"))
    declared = t.part.where("p_partkey % 4 <> 0").select(n.alias("id"), F.floor(n / 3).cast("long").alias("scope_id"), F.concat(F.lit("v"), n % 11).alias("name"))
    uses = t.part.select(n.alias("use_id"), n.alias("scope_id"), F.concat(F.lit("v"), F.col("p_size") % 12).alias("name"))
    return M.resolve_in_scope(uses, scopes, declared).withColumn("declaration", F.concat(F.lit("d"), "declaration"))


@query("SELECT p_type AS dependency, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS consumers, string_agg(DISTINCT '1.' || (p_size % 3), ',' ORDER BY '1.' || (p_size % 3)) AS versions, count(DISTINCT p_size % 3) = 1 AS compatible FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def shared_modules(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_type").alias("dependency"), F.col("p_brand").alias("module"), F.concat(F.lit("1."), F.col("p_size") % 3).alias("version"))
    return M.shared_modules(d).select("dependency", F.array_join("consumers", ",").alias("consumers"), F.array_join("versions", ",").alias("versions"), "compatible")


@query(f"WITH {COMMS}, m AS (SELECT DISTINCT pkg, array_to_string(list_slice(string_split(pkg, '/'), 1, 2), '/') AS component FROM symbols) SELECT a.component AS src, b.component AS dst, count(*) AS n FROM comms JOIN m a ON a.pkg = src JOIN m b ON b.pkg = tgt WHERE a.component <> b.component GROUP BY 1, 2")
def component_edges(t: Tables) -> DataFrame:
    c = Code(t)
    member = M.components_by_prefix(c.symbols(), "pkg").select(F.col("package").alias("id"), "component")
    return M.component_edges(c.communications().select("src", F.col("tgt").alias("dst")), member)


@query("SELECT p_partkey AS id, '1.' || (p_size % 5) || '.0' AS current, '1.2.' || (p_partkey % 3) AS latest, (p_size % 5 < 2 OR (p_size % 5 = 2 AND p_partkey % 3 > 0)) AS has_update FROM part WHERE p_partkey % 4 <> 0")
def plugin_updates(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    installed = t.part.select(n.alias("id"), F.concat(F.lit("1."), F.col("p_size") % 5, F.lit(".0")).alias("current"))
    return J.outdated(installed, t.part.where("p_partkey % 4 <> 0").select(n.alias("id"), F.concat(F.lit("1.2."), n % 3).alias("latest")), V.parse)


@query(f"WITH {PATHS} SELECT id, path FROM paths WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^app\\.[^/]*$') AND contains(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END, 'doc')")
def filter_files(t: Tables) -> DataFrame:
    files = Code(t).paths().withColumn("is_test", F.lit(False))
    return L.filter_files(files, "app.*", package="doc").select("id", "path")


@query(
    f"""WITH {PATHS}, x AS (SELECT 'f' || id AS id, regexp_extract(path, '([^/]*)$', 1) AS name, path FROM paths WHERE regexp_matches(lower(path), '\\.(md|markdown|txt)$|readme')),
 s AS (SELECT *, CASE WHEN lower(name) = 'guide.md' THEN 0.95 WHEN lower(path) = 'guide.md' THEN 0.9 WHEN contains(lower(name), 'guide.md') THEN 0.6 WHEN contains(lower(path), 'guide.md') THEN 0.4 ELSE 0 END AS score FROM x)
 SELECT id, path, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 50"""
)
def search_documents(t: Tables) -> DataFrame:
    files = Code(t).paths().select(F.concat(F.lit("f"), "id").alias("id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path")
    return L.search_documents(files, "guide.md").select("id", "path", "score")


@query(
    f"""WITH {SYMBOLS}, p AS (SELECT pkg, count(*) FILTER (exported) AS e, count(*) FILTER (exported AND n % 5 = 0) AS d, count(DISTINCT file) FILTER (ends_with(file, '_test.go')) AS t, count(DISTINCT file) FILTER (NOT ends_with(file, '_test.go')) AS s FROM symbols GROUP BY 1)
 SELECT pkg, round(70.0 * CASE WHEN e > 0 THEN d::DOUBLE / e ELSE 0 END + CASE WHEN starts_with(pkg, 'pkg/') THEN 30 ELSE 0 END, 6) AS documentation, round(60.0 * CASE WHEN t > 0 THEN 1 ELSE 0 END + 40.0 * CASE WHEN s > 0 THEN least(1.0, t::DOUBLE / s) ELSE 0 END, 6) AS test FROM p"""
)
def package_scores(t: Tables) -> DataFrame:
    """Documentation and tests of each package; packages under pkg have documents, every fifth symbol a comment."""
    f = F.col("file")
    p = Code(t).symbols().groupBy("pkg").agg(
        F.count_if("exported").alias("e"), F.count_if(F.col("exported") & (F.col("n") % 5 == 0)).alias("d"),
        F.countDistinct(F.when(f.endswith("_test.go"), f)).alias("t"), F.countDistinct(F.when(~f.endswith("_test.go"), f)).alias("s"),
    )
    documentation = R.documentation_score(F.col("d"), F.col("e"), F.col("pkg").startswith("pkg/"))
    test = R.test_score((F.col("t") > 0).cast("int"), F.lit(1), F.col("t"), F.col("s"))
    return p.select("pkg", F.round(documentation, 6).alias("documentation"), F.round(test, 6).alias("test"))


@query(
    f"""WITH {REFS}, g AS (SELECT pkg || '#' || (n // 240) AS pkg, greatest(0, 100 - 4 * count(*) FILTER (name LIKE 'init%') - 8 * count(*) FILTER (file LIKE '%_test.go' AND NOT exported) - 1 * count(*) FILTER (kind = 'constant'))::DOUBLE AS s FROM symbols GROUP BY 1)
 SELECT pkg, s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM g"""
)
def severity_scores(t: Tables) -> DataFrame:
    """Medium, high and low findings take their weights off the score of each package's symbols, 240 numbers at a time."""
    share = F.floor(F.col("n") / 240).cast("string")
    s = Code(t).symbols().withColumn("pkg", F.concat("pkg", F.lit("#"), share))
    f = F.col("file").endswith("_test.go") & ~F.col("exported")
    parts = [s.where(c).select("pkg", F.lit(w).alias("severity")) for c, w in ((F.col("name").startswith("init"), "medium"), (f, "high"), (F.col("kind") == "constant", "low"))]
    total = A._union(parts).groupBy("pkg").agg(F.sum(R.severity_weight(F.col("severity"))).alias("w"))
    score = F.greatest(F.lit(0.0), 100.0 - F.coalesce("w", F.lit(0.0)))
    return s.select("pkg").distinct().join(total, "pkg", "left").select("pkg", score.alias("score"), R.grade(score).alias("grade"))


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%ring%' AND p_type = (SELECT min(p_type) FROM part)")
def filter_nodes(t: Tables) -> DataFrame:
    kind = t.part.agg(F.min("p_type")).first()[0]
    nodes = t.part.select(entity_id("part", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return L.filter_nodes(nodes, [kind], "RING").select("id", "name")
