"""Ends of long chains, circles and tails."""

import random

from pyspark.sql import functions as F

from plexmill.operators import pointers


def plain(links):
    out = {}
    for start in links:
        at, seen = start, [start]
        while at in links:
            at = links[at]
            if at in seen:
                break
            seen.append(at)
        cyclic = at in links
        out[start] = (at, seen.index(at), cyclic)
    return out


def test_equal_to_a_plain_walk(spark):
    rnd = random.Random(3)
    links = {f"{w}-{i}": f"{w}-{rnd.randrange(0, 24)}" for w in range(12) for i in range(24) if rnd.random() < 0.9}
    links |= {"self": "self", "nowhere": None}
    df = spark.createDataFrame(list(links.items()), "id string, target string").coalesce(1)
    got = {r.id: (r.end, r.steps, r.is_cyclic) for r in pointers.chase(df).collect()}
    assert got == plain(links)
    assert {c for *_, c in got.values()} == {True, False}


def test_a_chain_of_a_hundred_thousand_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], pointers.cut
    monkeypatch.setattr(pointers, "cut", lambda df: rounds.append(1) or cut(df))
    n = 100_000
    far = pointers.chase(spark.range(n).select("id", (F.col("id") + 1).alias("target")))
    assert far.agg(F.min("end"), F.max("end"), F.max("steps"), F.count("*")).first()[:] == (n, n, n, n)
    assert len(rounds) < 22


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a"), ("a", "c"), ("a", "b"), ("a", "b")], "id string, target string").coalesce(1)
    assert [tuple(r) for r in pointers.chase(df).collect()] == [("a", "b", 1, False)]
    assert pointers.chase(df.limit(0)).isEmpty()
