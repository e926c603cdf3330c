"""Import targets and modules against plain matching."""

import posixpath
import random

from pyspark.sql import functions as F

from plexmill.functions import text
from plexmill.operators import resolve


def test_clean_path(spark):
    paths = ["", ".", "./a", "a//b/./c", "a/../b", "../a", "../../a/..", "a/../..", "/a/../b/", "a/b/../../.."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.c for r in df.select("p", text.clean_path(F.col("p")).alias("c")).collect()}
    assert got == {p: posixpath.normpath(p) for p in paths}


def test_targets_equal_plain_matching(spark):
    rnd = random.Random(2)
    word = lambda k: "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, k)))
    packages = sorted({word(3) for _ in range(9)}) + [".", "deep/zz"]
    imports = [(k, word(2), rnd.choice(["", "", "./", "../", "../../", "x/"]) + word(5)) for k in range(300)] + [(900, "a", None), (901, None, "../a"), (902, "deep/q", "../zz"), (903, "deep/q/r", "../../zz"), (904, "deep", "../zz")]

    def plain(source, target):
        c = posixpath.normpath(target or "")
        hits = [p for p in packages if p != "." and (c == p or c.endswith("/" + p) or f"/{p}/" in c)]
        if hits:
            best = max(hits, key=lambda p: (len(p), p))
            return best, "exact" if best == c else "inside"
        joined = posixpath.normpath(posixpath.join(source or "", c))
        return (joined, "relative") if c.startswith("../") and joined in packages else (None, None)

    df = spark.createDataFrame(imports, "import_id int, source string, target string").coalesce(2)
    got = {r.import_id: (r.package, r.form) for r in resolve.import_targets(df, spark.createDataFrame([(p,) for p in packages], "package string")).collect()}
    assert got == {k: plain(s, t) for k, s, t in imports}
    assert {f for _, f in got.values()} == {None, "exact", "inside", "relative"}


def test_modules_by_longest_prefix_then_name(spark):
    modules = spark.createDataFrame([("one", "pkg/a"), ("two", "pkg/a/b"), ("deep/mod", None), ("mod", None)], "module string, package string")
    ids = ["pkg/a.X", "pkg/a/b.Y", "pkg/a/bc.Z", "pkg/ab.W", "x/deep/mod.T", "x/mod/y.T", "", None, "pkg/a/b"]
    got = {tuple(r) for r in resolve.entity_modules(spark.createDataFrame([(i,) for i in ids], "id string"), modules).collect()}
    assert got == {
        ("pkg/a.X", "one", "prefix"), ("pkg/a/b.Y", "two", "prefix"), ("pkg/a/bc.Z", "one", "prefix"), ("pkg/ab.W", "main", "default"),
        ("x/deep/mod.T", "deep/mod", "name"), ("x/mod/y.T", "mod", "name"), ("pkg/a/b", "two", "prefix"),
    }
