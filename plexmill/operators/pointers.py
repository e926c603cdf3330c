"""Ends of chains of links by pointer doubling: each round a name jumps as far again as it has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import dealt, written


def cut(df: DataFrame) -> DataFrame:
    """`df` written once, as a side that is dealt out by key."""
    return dealt(written(df))


def _doubled(links: DataFrame, most: int) -> DataFrame:
    """(id, end, steps, open) after as many rounds as chains of `most` links need; open where a link leads on."""
    cur = links.select("id", F.col("target").alias("end"), F.lit(1).cast("long").alias("steps"))
    far = 1
    while True:
        ahead = cur.select(F.col("id").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        j = cur.join(ahead, "end", "left")
        more = F.col("_steps").isNotNull()
        cur = cut(j.select("id", F.when(more, F.col("_end")).otherwise(F.col("end")).alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), more.alias("open")))
        if far >= most or cur.where("open").isEmpty():
            return cur
        far *= 2


def chase(links: DataFrame) -> DataFrame:
    """(id, end, steps, is_cyclic): where each link (id, target) leads to in the end, in the logarithm of the longest chain rounds.

    Of an id given twice the least target counts; null ids are left out; a null target ends its chain.  A chain that runs
    into a circle ends at the name that it would come to twice, which for a name on the circle is the name itself after no
    step.
    """
    one = cut(links.where("id is not null").groupBy("id").agg(F.min("target").alias("target")))
    # `open` says that a link led on in the last round, so ends are those to which no link belongs.
    walked = _doubled(one, one.count())
    names = one.select(F.col("id").alias("end"), F.lit(True).alias("_on"))
    walked = cut(walked.join(names, "end", "left").select("id", "end", "steps", F.coalesce("_on", F.lit(False)).alias("is_cyclic")))
    straight = walked.where("not is_cyclic")
    ring = cut(walked.where("is_cyclic").select(F.col("end").alias("id")).distinct())  # after so many steps all are on their circle
    if ring.isEmpty():
        return straight
    turned = ring.select("id", F.col("id").alias("end"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("is_cyclic"))
    tail = cut(one.join(walked.where("is_cyclic").select("id"), "id", "left_semi").join(ring, "id", "left_anti"))
    if not tail.isEmpty():
        turned = turned.unionByName(_doubled(tail, tail.count()).select("id", "end", "steps", F.lit(True).alias("is_cyclic")))
    return straight.unionByName(turned)


def owners(edges: DataFrame, kind: str = "belongs_to") -> DataFrame:
    """(id, root, length): the last owner of each node by its first edge (least id) of the kind, and how many nodes its chain has.

    In a circle of owners the root is the node that would come twice, and the chain ends before it does.
    """
    links = edges.where(F.col("kind") == kind).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "id").alias("target"))
    return chase(links).select("id", F.col("end").alias("root"), (F.col("steps") + 1).alias("length"))
