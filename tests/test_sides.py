"""Sides of joins that grow with the tables are dealt out by key, not sent to the driver."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plexmill.operators import audit as A
from plexmill.plans import code_queries, code_reports, code_sources, queries  # noqa: F401 -- these register queries
from plexmill.plans.code import Code
from plexmill.plans.relations import Tables

from .conftest import SF


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_references_send_no_symbols(spark):
    assert broadcasts(Code(Tables(spark, SF)).references()) == 0


#: What may be sent: pairs and names of packages.
@pytest.mark.parametrize(("name", "most"), [(n, 0) for n in ("communications", "move_safety", "tree_levels", "tree_depth", "resolve_scopes", "alias_chains", "go_references", "go_calls", "file_impact", "package_impact")] + [("graph_recommendations", 2)])
def test_queries_send_no_growing_side(spark, name, most):
    assert broadcasts(queries.QUERIES[name](spark, SF)) <= most


@pytest.mark.parametrize("name", ["go_declarations", "version_rules"])
def test_one_small_file_is_dealt_over_all_tasks(spark, name):
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sources_are_read_once_for_scopes(spark):
    assert "MapInArrow" not in queries.QUERIES["go_scopes"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_impact_of_a_package_is_not_listed_target_by_target(spark):
    """Two targets reached by the same callers: a row for a caller and a package, and the targets' own package left out."""
    symbols = spark.createDataFrame([("a.X", "a", "a/x"), ("a.Y", "a", "a/y"), ("b.P", "b", "b/p"), ("b.Q", "b", "b/p"), ("c.R", "c", "c/r")], "id string, pkg string, file string")
    calls = spark.createDataFrame([("b.P", "a.X"), ("b.P", "a.Y"), ("b.Q", "b.P"), ("c.R", "b.Q"), ("b.P", "c.R"), ("a.Y", "c.R")], "src string, dst string")
    targets = symbols.where("pkg = 'a'").select(symbols.id.alias("target"))
    for key in ("pkg", "file"):
        got = A.impact_of_keys(calls, calls, targets, symbols, key)
        assert sorted(got.collect()) == sorted(A.impact_by(A.impact_of_symbols(calls, calls, targets), symbols, key).collect())
    front = A._upward(calls, calls.where("dst like 'a.%'").selectExpr("'a' as target", "src as id").distinct(), keys=True)
    assert front.count() == front.distinct().count()


def test_impact_reads_references_once_and_walks_only_what_is_called(spark, monkeypatch):
    read = []
    monkeypatch.setattr(Tables, "lineitem", property(lambda t: read.append(t) or t.spark.read.parquet(f"{t.folder}/lineitem.parquet")), raising=False)
    for name in ("package_impact", "file_impact"):
        read.clear()
        queries.QUERIES[name](spark, SF)
        assert len(read) == 1
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "b"), ("y", "c"), ("a", "c"), ("c", "c")], "src string, dst string")
    direct = spark.createDataFrame([("a", "b"), ("a", "z")], "target string, id string")
    assert sorted(map(tuple, A._called(calls, direct)[1].collect())) == [("a", "b"), ("a", "c")]
    assert sorted(map(tuple, A._upward(calls, direct).collect())) == [("a", "c"), ("a", "x"), ("a", "y")]


def test_numbers_stand_for_references(spark):
    c = Code(Tables(spark, SF))
    s = c.numbered()
    ids = [r.id for r in s.orderBy("number").collect()]
    assert ids == sorted(r.id for r in c.symbols().collect())
    r = c.numbered_references(s, "pkg/math")
    named = lambda df: df.join(s.selectExpr("number src", "id s"), "src").join(s.selectExpr("number dst", "id d"), "dst").select("s", "d")
    assert sorted(set(named(r.where("called")).collect())) == sorted(c.calls().select("src", "dst").collect())
    asked = c.references().where("dst_pkg = 'pkg/math' and dst <> ''").select("src", "dst")
    assert sorted(named(r.where("asked")).collect()) == sorted(asked.collect())


@pytest.mark.parametrize(("wide", "edges"), [(2048, 1_000_000), (70, 300), (3, 40)])
def test_counted_impact_equals_listed_pairs(spark, wide, edges):
    """In one block and in many; targets that call each other or themselves, more than a word of them, references that are no calls."""
    r = random.Random(4)
    called = [(r.randrange(400), r.randrange(200) if k % 3 else r.randrange(12)) for k in range(900)]
    called = spark.createDataFrame([(a << 33, b << 33) for a, b in called], "src long, dst long")
    other = spark.createDataFrame([(r.randrange(400) << 33, r.randrange(200) << 33) for _ in range(200)], "src long, dst long")
    targets = spark.range(150).selectExpr("shiftleft(id, 33) target")
    uses = called.unionByName(other)
    got = A.impact_counts(uses, called, targets, wide, edges)
    listed = A.impact_of_symbols(uses, called, targets).groupBy("target", "how").agg(F.count("*").alias("n"), F.min("symbol").alias("first"))
    assert sorted(got.collect()) == sorted(listed.collect())
    assert {x.how for x in got.collect()} == {"direct", "transitive"}


def test_rounds_of_counted_impact_list_no_pairs(spark, monkeypatch):
    """150 targets reached by the same 42 called symbols, 6,300 pairs: what is kept has a row for some hundred targets."""
    edges = [(1000, t) for t in range(150)] + [(1001 + k, 1000) for k in range(40)] + [(2000, 1001 + k) for k in range(40)] + [(2001, 2000), (2002, 2001)]
    called = spark.createDataFrame(edges, "src long, dst long")
    targets = spark.range(150).selectExpr("id target", "149 - id near")
    listed = A.impact_of_symbols(called, called, targets).groupBy("target", "how").agg(F.count("*").alias("n"), F.min("symbol").alias("first")).collect()
    kept = []
    for where, name in ((A.G, "cut"), (A, "written")):
        keep = getattr(where, name, None)
        monkeypatch.setattr(where, name, lambda df, keep=keep: kept.append(keep(df)) or kept[-1], raising=False)
    assert sorted(A.impact_counts(called, called, targets).collect()) == sorted(listed)
    assert max(df.count() for df in kept) <= len(edges)


def test_counted_impact_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert A.impact_counts(none, none, spark.range(3).selectExpr("id target")).collect() == []


def test_symbol_impact_counts_in_blocks_and_sends_no_side(spark):
    counts = queries.QUERIES["symbol_impact"](spark, SF)
    assert "FlatMapGroupsInArrow" in counts._jdf.queryExecution().executedPlan().toString()
    assert broadcasts(counts) == 0


def test_go_sources_are_kept_in_columns(spark):
    """What is kept of 200 sources and the rounds over them: 0.3 MB in columns, 1.2 MB row by row."""
    size = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if f.is_file() and f.suffix != ".crc")
    before = size()
    queries.QUERIES["go_receiver_calls"](spark, SF)
    assert 0 < size() - before < 600_000
