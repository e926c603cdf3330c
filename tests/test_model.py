"""The knowledge-graph builders on small relations."""

from pyspark.sql import functions as F

from plexmill.operators import model


def test_assemble_keeps_edges_between_nodes(spark):
    files = spark.createDataFrame([("a/x.go",), ("main.go",)], "path string")
    symbols = spark.createDataFrame([("a.F", "F", "a", "a/x.go"), ("main", "main", ".", "main.go")], "id string, name string, package_path string, file_path string")
    refs = spark.createDataFrame([("main", "a.F", "call"), ("main", "gone", "call")], "source string, target string, kind string")
    deps = spark.createDataFrame([(".", "a")], "src string, dst string")
    nodes, edges = model.assemble(files, symbols, refs, deps)
    assert nodes.count() == 6
    assert {(r.src, r.dst, r.kind) for r in edges.collect()} == {
        ("package:a", "file:a/x.go", "owns"), ("package:.", "file:main.go", "owns"), ("file:a/x.go", "symbol:a.F", "contains"),
        ("file:main.go", "symbol:main", "contains"), ("symbol:main", "symbol:a.F", "calls"), ("package:.", "package:a", "depends_on"),
    }
    got = {r.id: r.classification for r in model.removals(nodes, edges, F.col("type")).collect()}
    assert got["symbol:a.F"] == "potentially_breaking" and got["symbol:main"] == "safe"
    around = {(r.kind, r.direction): r.others for r in model.context(edges, F.col("id") == "symbol:a.F").collect()}
    assert around == {("contains", "in"): ["file:a/x.go"], ("calls", "in"): ["symbol:main"]}


def test_types_resolve_by_priority(spark):
    types = spark.createDataFrame([("p.T", "T", "p", "p"), ("q.T", "T", "q", "q"), ("q.U", "U", "q", "q")], "id string, name string, package string, package_name string")
    uses = spark.createDataFrame([(1, "*T", "p"), (2, "q.T", "p"), (3, "[]U", "p"), (4, "T", "z"), (5, "map[string]X", "p"), (6, "V", "p"), (7, "int", "p")], "use_id long, expr string, package string")
    got = {r.use_id: (r.state, r.type_id) for r in model.resolve_types(uses, types).collect()}
    assert got == {1: ("resolved", "p.T"), 2: ("resolved", "q.T"), 3: ("resolved", "q.U"), 4: ("ambiguous", None), 5: ("resolved", None), 6: ("unresolved", None), 7: ("resolved", None)}


def test_aliases_end_or_turn_in_a_circle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "id string, target string")
    got = {r.id: (r.end, r.is_cyclic) for r in model.alias_ends(df).collect()}
    assert got["a"] == ("c", False) and got["b"] == ("c", False) and got["x"][1] and got["y"][1]


def test_the_nearest_scope_wins(spark):
    scopes = spark.createDataFrame([("file", None), ("func", "file"), ("block", "func")], "scope_id string, parent_id string")
    decls = spark.createDataFrame([("d1", "file", "v"), ("d2", "func", "v"), ("d3", "func", "w"), ("d4", "func", "w")], "id string, scope_id string, name string")
    uses = spark.createDataFrame([(1, "block", "v"), (2, "file", "v"), (3, "block", "w"), (4, "block", "z")], "use_id long, scope_id string, name string")
    got = {r.use_id: (r.state, r.declaration) for r in model.resolve_in_scope(uses, scopes, decls).collect()}
    assert got == {1: ("resolved", "d2"), 2: ("resolved", "d1"), 3: ("ambiguous", None), 4: ("unresolved", None)}


def test_hierarchies_and_modules(spark):
    s = spark.createDataFrame([("p.T", "T", "p", ""), ("p.(*T).M", "M", "p", "*T"), ("q.(*T).N", "N", "q", "*T")], "id string, name string, package_path string, receiver string")
    assert {r.child: r.parent for r in model.hierarchy(s).collect()} == {"p.T": "package:p", "p.(*T).M": "p.T", "q.(*T).N": "package:q"}
    p = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/b/c/d",), ("a/bx",)], "path string")
    assert [r.package for r in model.child_packages(p, "a/b").collect()] == ["a/b/c"]
    assert {(r.component, r.package) for r in model.components_by_prefix(p, "path").collect()} == {("a/b", "a/b"), ("a/b", "a/b/c"), ("a/b", "a/b/c/d"), ("a/bx", "a/bx")}
    d = spark.createDataFrame([("m", "x", "1"), ("n", "x", "2"), ("m", "y", "1")], "module string, dependency string, version string")
    assert [(r.dependency, r.consumers, r.compatible) for r in model.shared_modules(d).collect()] == [("x", ["m", "n"], False)]
    i = spark.createDataFrame([("f", "lib/used"), ("f", "lib/idle")], "file string, target string")
    r = spark.createDataFrame([("f", "used.Do"), ("g", "idle.Do")], "file string, target string")
    assert [x.target for x in model.unused_imports(i, r).collect()] == ["lib/idle"]
