"""Graphs deeper than any former limit on rounds."""

from plexmill.operators import graph


def test_depth_and_owners_beyond_a_hundred_levels(spark):
    n = 104
    e = spark.createDataFrame([(f"e{k:03}", f"n{k:03}", f"n{k + 1:03}", "belongs_to") for k in range(n)], "id string, src string, dst string, kind string").coalesce(1).cache()
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(n + 1)], "id string").coalesce(1).cache()
    assert graph.max_depth(nodes, e).first().max_depth == n
    first = graph.ownership(e).where("id = 'n000'").first()
    assert first.root == f"n{n:03}" and len(first.chain) == n + 1
