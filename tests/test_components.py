"""Strongly connected components and longest paths against plain versions, and on long rings and deep graphs."""

import random

import pytest
from pyspark.sql import functions as F

from plexmill.operators import components as C
from plexmill.operators import graph


def plain_components(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    r = {x: reach(x) for x in out}
    return {x: min(y for y in out if y in r[x] and x in r[y]) for x in out}


def shape(seed):
    r = random.Random(seed)
    n = 30
    if seed == 0:  # two rings joined by a bridge, a tail and a loop
        return [(k, (k + 1) % 7) for k in range(7)] + [(10 + k, 10 + (k + 1) % 5) for k in range(5)] + [(3, 10), (14, 20), (20, 21), (21, 21), (30, 30)]
    if seed == 1:  # a dense core, all of degree two and more, with chains in and out
        return [(a, b) for a in range(6) for b in range(6) if a != b] + [(a, b) for a in range(6, 11) for b in range(6, 11) if a != b] + [(0, 7), (11, 12), (12, 0), (7, 13)]
    return [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([20, 35, 60, 90]))]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_plain_version(spark, seed):
    pairs = shape(seed)
    df = spark.createDataFrame([*pairs, *pairs[:3]], "src long, dst long")
    comp = C.strong_components(df).cache()
    want = plain_components(pairs)
    assert sorted(map(tuple, comp.collect())) == sorted(want.items())
    size = {c: list(want.values()).count(c) for c in want.values()}
    assert {r.id for r in C.on_cycles(df).collect()} == {x for x, c in want.items() if size[c] > 1}
    joined = {(r.src, r.dst): r.n for r in C.condensed(df.distinct(), comp).collect()}
    assert set(joined) == {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}


def test_no_edges(spark):
    assert C.strong_components(spark.createDataFrame([], "src string, dst string")).collect() == []
    assert C.longest_path(spark.createDataFrame([], "src string, dst string"), "a", 4).first().depth == 0


def test_a_long_ring_with_tails(spark, monkeypatch):
    """A ring, a tail into it and one out of it: rounds in the logarithm of its length."""
    n = 300
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(60).select((n + F.col("id")).alias("src"), (n + 1 + F.col("id")).alias("dst"))
    more = spark.createDataFrame([(n + 60, 17), (40, 900_000), (900_000, 900_001)], "src long, dst long")
    rounds = []
    monkeypatch.setattr(C, "_degrees", lambda e, f=C._degrees: rounds.append(1) or f(e))
    comp = C.strong_components(ring.unionByName(tail).unionByName(more)).cache()
    assert len(rounds) < 30
    sizes = {r.component: r["count"] for r in comp.groupBy("component").count().where("count > 1").collect()}
    assert sizes == {0: n} and comp.count() == n + 61 + 2


def plain_longest(pairs, start, most):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def walk(x, seen):
        if len(seen) > most:
            return most
        return max([len(seen) - 1, *(walk(y, seen | {y}) for y in out.get(x, ()) if y not in seen)])

    return min(most, walk(start, {start}))


@pytest.mark.parametrize("seed", range(2))
def test_longest_paths_equal_a_plain_version(spark, seed):
    r = random.Random(40 + seed)
    pairs = shape(0) if seed == 0 else [(r.randrange(14), r.randrange(14)) for _ in range(r.choice([16, 20, 24]))]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    for most in (9,):
        assert C.longest_path(df, str(pairs[0][0]), most).first().depth == plain_longest(pairs, pairs[0][0], most)


def test_depth_of_a_wide_graph_without_cycles(spark):
    """Two thousand nodes in 8 layers, each with three ways on."""
    layer = spark.range(2_000).withColumn("x", F.floor(F.col("id") / 250))
    edges = layer.where("x < 7").select(F.col("id").cast("string").alias("src"), F.explode(F.array(*[((F.col("x") + 1) * 250 + (F.col("id") * 7 + k) % 250) for k in range(3)])).alias("dst"))
    edges = edges.withColumn("dst", F.col("dst").cast("string"))
    edges = edges.withColumns({"kind": F.lit("calls"), "id": F.concat_ws("-", "src", "dst")})
    assert graph.call_depth(edges, "0", 90).first().depth == 7
