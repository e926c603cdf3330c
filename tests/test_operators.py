"""Operators on small literal relations."""

import json

import pytest
from pyspark.sql import functions as F

from plexmill.functions import content, text, version
from plexmill.operators import graph, lookup, ranking, resolve, rules
from plexmill.sinks import export
from plexmill.sources import manifests, scan
from plexmill.streaming import events


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "go.mod": "module sample\n\ngo 1.21\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n",
        "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"sample/pkg/math"\n)\n\n// main runs.\nfunc main() {\n\tfmt.Println(math.Add(1, 2))\n}\n',
        "pkg/math/math.go": "package math\n\ntype Calculator interface {\n\tCompute(a, b int) int\n}\n\ntype Basic struct{}\n\nfunc (b *Basic) Compute(a, b2 int) int { return Add(a, b2) }\n\nfunc Add(a, b int) int { return a + b }\n\nconst Limit = 3\n",
        "package.json": json.dumps({"dependencies": {"x": "^1.0.0"}, "devDependencies": {"y": "2"}}),
        "Cargo.toml": '[package]\nname = "z"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["a"] }\n[dev-dependencies]\nrand = "0.8"\n',
        "pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>",
        "build.gradle": "dependencies {\n  implementation 'g:a:1.0'\n  testImplementation(\"g:t:2.0\")\n}\n",
        "requirements.txt": "# c\nnumpy==1.2\nflask[async]>=2.0 # web\npandas\n",
        "node_modules/skip.js": "x",
        ".hidden/h.txt": "x",
        "README.md": "# t\r\n",
        "web/app.ts": "import { a } from 'lib';\nconst b = require('other');\n",
    }
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body.encode())
    return str(root)


def test_scan_prunes_and_classifies(spark, repository):
    rows = {r.path: r for r in scan.inspect(scan.scan(spark, repository)).collect()}
    assert "node_modules/skip.js" not in rows and ".hidden/h.txt" not in rows and rows["main.go"].language == "go"
    assert rows["README.md"].line_ending == "CRLF" and rows["README.md"].kind == "documentation" and rows["main.go"].kind == "source"
    assert rows["main.go"].lines == 11 and rows["main.go"].comment_lines == 1 and rows["main.go"].encoding == "ASCII"
    assert scan.scan(spark, repository, max_files=2).count() == 2 and scan.scan(spark, repository, max_depth=1).where("path like '%/%'").isEmpty()


def test_manifests(spark, repository):
    got = {(r.ecosystem, r.name, r.version, r.dep_type) for r in manifests.dependencies(scan.scan(spark, repository)).collect()}
    assert got == {
        ("go", "github.com/a/b", "v1.2.3", "runtime"), ("go", "github.com/c/d", "v0.1.0", "indirect"), ("npm", "x", "^1.0.0", "runtime"), ("npm", "y", "2", "dev"),
        ("cargo", "serde", "1.0", "runtime"), ("cargo", "tokio", "1.2", "runtime"), ("cargo", "rand", "0.8", "dev"), ("maven", "g:a", "1", "dev"),
        ("gradle", "g:a", "1.0", "runtime"), ("gradle", "g:t", "2.0", "dev"), ("pypi", "numpy", "==1.2", "runtime"), ("pypi", "flask", ">=2.0", "runtime"), ("pypi", "pandas", "", "runtime"),
    }


def test_imports_and_symbols(spark, repository):
    files = scan.scan(spark, repository)
    assert {(r.path, r.target) for r in manifests.imports(files).collect()} == {("main.go", "fmt"), ("main.go", "sample/pkg/math"), ("web/app.ts", "lib"), ("web/app.ts", "other")}
    got = {r.id: r.kind for r in manifests.go_symbols(files).collect()}
    assert got == {
        "main": "function", "pkg/math.Calculator": "interface", "pkg/math.Basic": "struct", "pkg/math.(*Basic).Compute": "method",
        "pkg/math.Add": "function", "pkg/math.Limit": "const",
    }


def test_incremental_scan_returns_changed_files(spark, repository):
    now = scan.inspect(scan.scan(spark, repository))
    before = now.withColumn("content_hash", F.when(F.col("path") == "main.go", "old").otherwise(F.col("content_hash")))
    assert [r.path for r in scan.changed(now, before).collect()] == ["main.go"]


def test_reflog(spark, tmp_path):
    (tmp_path / "HEAD").write_text("0 a1 Ann B <a@x> 1700000000 +0100\tcommit: one\na1 b2 Ann B <a@x> 1600000000 +0000\tcommit: two\nbroken\n")
    log = scan.reflog(spark, str(tmp_path / "HEAD"))
    one = scan.commit_stats(log).first()
    assert one.commits == 2 and one.first_sha == "a1" and one.last_sha == "b2" and one.first < one.last
    assert scan.contributors(log).first().commits == 2
    (tmp_path / "packed").write_text("# pack\nc1 refs/tags/v1.0.0\n^d1\ne1 refs/tags/v2.0.0-rc1\nf1 refs/heads/x\n")
    got = {r.tag: (r.sha, r.prerelease) for r in scan.releases(scan.packed_tags(spark, str(tmp_path / "packed"))).collect()}
    assert got == {"v1.0.0": ("d1", None), "v2.0.0-rc1": ("e1", "rc")}


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(f"{a}{b}{i}", a, b, kind) for i, (a, b) in enumerate(pairs)], "id string, src string, dst string, kind string")


def test_graph_limits(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")])
    start = spark.createDataFrame([("s", "a")], "seed string, id string")
    assert graph.bfs(e, start, "outbound", 0).count() == 1
    with pytest.raises(ValueError):
        graph.bfs(e, start, "outbound", 101)
    assert sorted(r.hops for r in graph.simple_paths(e, "a", "c", 3).collect()) == [2, 2]
    assert graph.simple_paths(e, "a", "c", 2).isEmpty()
    assert [r.cycle for r in graph.cycles(e, 3).collect()] == [["a", "b", "c"]]


def test_topological_levels_leave_cycles_out(spark):
    e = edges(spark, [("app", "lib"), ("lib", "core"), ("x", "y"), ("y", "x")])
    nodes = spark.createDataFrame([(n,) for n in ("app", "lib", "core", "x", "y")], "id string")
    assert {r.id: r.level for r in graph.topological_levels(nodes, e).collect()} == {"core": 0, "lib": 1, "app": 2, "x": None, "y": None}


def test_canonical_cycles_unite_rotations(spark):
    a = lambda s: F.array(*map(F.lit, s))
    row = spark.range(1).select(text.canonical_cycle(a("aba")).alias("x"), text.canonical_cycle(a("bab")).alias("y")).first()
    assert row.x == row.y == "a -> b -> a"


@pytest.mark.parametrize(
    ("constraint", "value", "holds"),
    [("^1.2.0", "1.9.0", True), ("^1.2.0", "2.0.0", False), ("~1.2.0", "1.3.0", False), (">=1.0.0, <2.0.0", "1.5.0", True), ("*", "0.0.1", True),
     ("1.0.0", "1.0.0", True), ("^0.2.1", "0.3.0", False), (">1.0.0-rc", "1.0.0", True), ("bad", "1.0.0", False)],
)
def test_constraints(spark, constraint, value, holds):
    assert spark.range(1).select(version.satisfies(F.lit(constraint), version.parse(F.lit(value))).alias("x")).first().x is holds


def test_loose_version(spark):
    v = spark.range(1).select(version.parse_loose(F.lit("^1.2.3-alpha.1+build123")).alias("v"), version.parse_loose(F.lit("")).alias("e")).first()
    assert (v.v.major, v.v.minor, v.v.patch, v.v.prerelease, v.v.build, v.v.is_constraint, v.v.is_valid) == (1, 2, 3, "alpha.1", "build123", True, True)
    assert not v.e.is_valid and v.e.raw == ""


def test_best_versions(spark):
    want = spark.createDataFrame([("a", "^1.0.0"), ("a", "<1.5.0"), ("b", ">9.0.0")], "dependency string, constraint string")
    have = spark.createDataFrame([("a", "1.2.0"), ("a", "1.4.9"), ("a", "1.10.0"), ("b", "1.0.0")], "dependency string, version string")
    got = {r.dependency: r.version for r in ranking.best_versions(want, have, version.parse, version.satisfies).collect()}
    assert got == {"a": "1.4.9", "b": None}


def test_encodings(spark):
    rows = [(b"\xff\xfea\x00", "UTF-16"), (b"a\x00b", "Unknown"), (b"plain", "ASCII"), ("é".encode(), "UTF-8"), (b"\xc3(", "Invalid"), (b"", "ASCII")]
    df = spark.createDataFrame(rows, "b binary, want string").withColumn("got", content.encoding(F.col("b")))
    assert all(r.got == r.want for r in df.collect())


def test_exact_search_scores_below_one(spark):
    df = spark.createDataFrame([("1", "ring", "p/ring"), ("2", "rings", "p/rings"), ("3", "x", "ring/x")], "id string, name string, path string")
    assert [(r.id, round(r.score, 3)) for r in lookup.search({"d": df}, "ring").collect()] == [("1", 0.95), ("2", 0.88), ("3", 0.4)]
    assert lookup.search({"d": df}, "*").count() == 3


def test_interfaces_without_methods(spark):
    need = spark.createDataFrame([("i", "p", "A", "()"), ("i", "p", "B", ""), ("none", "p", None, None)], "interface_id string, package string, name string, signature string")
    have = spark.createDataFrame([("t", "p", "A", "()"), ("t", "p", "B", "(x)"), ("u", "p", "A", "(y)"), ("u", "p", "B", "")], "type_id string, package string, name string, signature string")
    assert [tuple(r) for r in resolve.satisfied_interfaces(need, have).collect()] == [("t", "i")]
    assert resolve.satisfied_interfaces(need, have, empty_holds=True).count() == 3


def test_findings_are_sorted_by_severity(spark):
    f = spark.createDataFrame([("r", "low", "a", ""), ("r", "critical", "b", ""), ("r", "low", "a", "")], "rule string, severity string, target string, detail string")
    assert [r.severity for r in rules.sorted_findings(f).collect()] == ["critical", "low"]
    assert rules.score(f.distinct()).first().score == 84.0


def test_audit_chain_finds_the_first_change(spark):
    import hashlib

    rows, prev = [], ""
    for seq in range(1, 6):
        h = hashlib.sha256(f"{prev}:e{seq}".encode()).hexdigest()
        rows.append(("l", seq, prev, h, f"e{seq}"))
        prev = h
    df = spark.createDataFrame(rows, "log string, seq long, prev_hash string, hash string, kind string")
    assert events.verify_chain(df, ["kind"]).isEmpty()
    bad = df.withColumn("kind", F.when(F.col("seq") == 3, "other").otherwise(F.col("kind")))
    assert [(r.seq, r.problem) for r in events.verify_chain(bad, ["kind"]).collect()] == [(3, "tampered")]
    assert events.verify_chain(df.where("seq <> 3"), ["kind"]).first().problem == "gap"


def test_streamed_counters_equal_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.publish(batch, str(tmp_path / "in"))
    live = events.stream(spark, str(tmp_path / "in"), batch.schema)
    q = events.counters(live, "user_id", F.col("event_type") == "error").writeStream.outputMode("complete").format("memory").queryName("c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r)[:3] for r in events.counters(batch, "user_id", F.col("event_type") == "error").collect()}
    assert {tuple(r)[:3] for r in spark.table("c").collect()} == want
    seen = []
    q = events.subscribe(live, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"), "click")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == batch.where("event_type = 'click'").count()


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a:1", "package", 'n"1'), ("b", "symbol", "<x>")], "id string, type string, name string")
    e = edges(spark, [("a:1", "b")])
    assert 'node_a_1 [label="n\\"1", shape=folder]' in export.graph_text(nodes, e, "dot")
    assert "id_a_1 -->|calls| id_b" in export.graph_text(nodes, e, "mermaid")
    assert "&lt;x&gt;" in export.graph_text(nodes, e, "graphml")
    assert len(export.graph_text(nodes, e, "json").strip().split("\n")) == 3
    assert "| id | type | name |" in export.markdown("t", [("s", nodes)]) and "<th>id</th>" in export.html_report("t", [("s", nodes)])
    for form in ("csv", "json", "parquet", "xml"):
        export.write_table(nodes, str(tmp_path / form), form)
    with pytest.raises(Exception, match="exist"):
        export.write_table(nodes, str(tmp_path / "csv"), "csv")
    export.write_text(str(tmp_path / "t.txt"), "x")
    with pytest.raises(FileExistsError):
        export.write_text(str(tmp_path / "t.txt"), "y")
