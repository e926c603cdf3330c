"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) given in the directions it needs.

    The minimum is taken by a partial aggregate, so a hub's neighbours are never
    gathered in one task; the join back to the edges is one that adaptive
    execution may split.
    """
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least.withColumn("m", F.least("u", "m")), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), both long.

    component is the smallest node reachable.  Nodes without an edge don't occur.
    Each round is written to the shared folder, so a lost executor costs no more
    than the round under way.  Self-links, null ends and repeated rows are ignored.
    """
    cur = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    cur = work.save(cur, "edges")

    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = state(cur)
    if seen[0] == 0:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        flipped = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))
        after = work.save(_star(_star(cur.unionByName(flipped), True), False), "star")
        now = state(after)
        work.drop(cur)
        cur = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
