"""Snapshots after edits, held against reading everything again."""

from plexmill.sources import incremental

BASE = {
    "a/a.go": 'package a\n\nimport "b"\n\nfunc Use() {\n\tx := b.New()\n\tx.Go()\n\ty := x.Deep()\n\ty.Stop()\n}\n',
    "a/own.go": "package a\n\nfunc Own() { Use() }\n",
    "b/b.go": 'package b\n\nimport "c"\n\ntype T struct{}\n\nfunc New() *T { return nil }\n\nfunc (t *T) Go() {}\n\nfunc (t *T) Deep() *c.U { return nil }\n',
    "c/c.go": "package c\n\ntype U struct{}\n\nfunc (u *U) Stop() {}\n",
    "d/d.go": "package d\n\nfunc D() { E() }\nfunc E() {}\n",
    "e/e.go": "package e\n\nfunc F() { F() }\n",
    "readme.md": "no source",
}


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string").coalesce(1)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def check(spark, snapshot, files, parsed):
    got, read = incremental.update(frame(spark, files), snapshot)
    want = incremental.full(frame(spark, files))
    assert {r.path for r in read.collect()} == parsed
    for name in incremental.Snapshot._fields:
        assert rows(getattr(got, name)) == rows(getattr(want, name)), name
    return got


def test_edits_deletes_and_renames(spark, tmp_path):
    first = incremental.full(frame(spark, BASE))
    assert {(r.source, r.target, r.state) for r in first.references.where("source = 'a.Use'").collect()} >= {("a.Use", "c.(*U).Stop", "resolved")}
    incremental.save(first, str(tmp_path / "one"))
    files, snapshot = dict(BASE), incremental.load(spark, str(tmp_path / "one"))
    snapshot = check(spark, snapshot, files, set())
    files["d/d.go"] = "package d\n\n\nfunc D() { E(); E() }\nfunc E() {}\n"  # a body, and lines
    snapshot = check(spark, snapshot, files, {"d/d.go"})
    files["c/c.go"] = "package c\n\ntype U struct{}\n\nfunc (u *U) Halt() {}\n"  # the end of a chain through b
    snapshot = check(spark, snapshot, files, {"c/c.go"})
    assert snapshot.references.where("target = 'c.(*U).Stop'").isEmpty()
    files["c/more.go"] = "package c\n\nfunc (u *U) Stop() {}\n"  # and there again
    snapshot = check(spark, snapshot, files, {"c/more.go"})
    assert not snapshot.references.where("target = 'c.(*U).Stop' and state = 'resolved'").isEmpty()
    files["f/b.go"] = files.pop("b/b.go")  # a rename
    snapshot = check(spark, snapshot, files, {"f/b.go"})
    del files["e/e.go"], files["d/d.go"]
    check(spark, snapshot, files, set())


def test_only_affected_packages(spark):
    first = incremental.full(frame(spark, BASE))
    changed = BASE | {"c/c.go": "package c\n\ntype U struct{}\n"}
    after = incremental.full(frame(spark, changed))
    assert {r.package for r in incremental.affected_packages(first.rows, after.rows).collect()} == {"a", "b", "c"}
    body = incremental.full(frame(spark, BASE | {"e/e.go": "package e\n\nfunc F() { F(); F() }\n"}))
    assert incremental.affected_packages(first.rows, body.rows).isEmpty()


def test_from_and_to_nothing(spark):
    none = incremental.full(frame(spark, {}))
    some = check(spark, none, BASE, {p for p in BASE if p.endswith(".go")})
    check(spark, some, {}, set())
