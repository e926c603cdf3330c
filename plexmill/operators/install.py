"""Installation plans: versions chosen through all dependencies, and a total order to install them in.

Plans of any number of targets are made together, a breadth-first level of all of them in each round of joins.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import version as V
from .audit import best_versions
from .rounds import written as cut

_CHOSEN = ["target", "id", "version", "depth", "requested_by"]
_PROBLEM = ["target", "id", "dependency", "constraint", "problem"]


def _fits(constraint: str, version: str):
    return F.coalesce(V.satisfies(F.coalesce(constraint, F.lit("")), V.parse(F.col(version))), F.lit(False))


def select_versions(targets: DataFrame, catalog: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, used, problems) of a plan for each target.

    targets: (target, version); catalog: (id, version, discoverable); dependencies: (id, dependency, constraint,
    optional, ordinal), the same for all versions of an id.  A plan is walked by breadth: by level, then in the order of
    who asks, then by ordinal.  Who first asks for an id gets its greatest discoverable version that fits; later ones
    must fit what was chosen.  An optional dependency that can't be had is passed over while nothing is chosen for it.

    chosen: (target, id, version, depth, requested_by), of plans with a problem too; used: (target, src, dst), the
    dependencies that count; problems: (target, id, dependency, constraint, problem), the first of each plan: not_found,
    version_not_found, missing, conflict.  Null constraints hold for any version, a null optional is false; repeated
    targets and dependencies count once; rows with a null target, id or dependency are left out.
    """
    deps = dependencies.where("id is not null and dependency is not null").select(
        "id", "dependency", F.coalesce("constraint", F.lit("")).alias("constraint"), F.coalesce("optional", F.lit(False)).alias("optional"), "ordinal"
    ).distinct()
    best = best_versions(deps.select(F.col("dependency").alias("id"), "constraint"), catalog)
    known = catalog.where("id is not null").select(F.col("id").alias("dependency"), F.lit(True).alias("known")).distinct()
    deps = deps.join(best.select(F.col("id").alias("dependency"), "constraint", F.col("version").alias("best")), ["dependency", "constraint"], "left")
    deps = cut(deps.join(known, "dependency", "left"))

    asked = targets.where("target is not null").select("target", "version").distinct()
    asked = asked.groupBy("target").agg(F.max("version").alias("version"))
    has = catalog.select(F.col("id").alias("target"), V.parse(F.col("version")).alias("_v")).distinct()
    is_there = asked.withColumn("_v", V.parse(F.col("version"))).join(has.withColumn("_has", F.lit(True)), ["target", "_v"], "left")
    is_there = cut(is_there.drop("_v").join(known.withColumnRenamed("dependency", "target"), "target", "left"))
    text = F.lit(None).cast("string")
    first = F.when(F.col("known").isNull(), "not_found").otherwise("version_not_found")
    problems = is_there.where("_has is null").select("target", F.col("target").alias("id"), text.alias("dependency"), text.alias("constraint"), first.alias("problem"))
    # A place is the ordinals on the way from the target: places of one level sort as its queue does.
    start = is_there.where("_has").select("target", F.col("target").alias("id"), "version", F.lit(0).alias("depth"), text.alias("requested_by"), F.array().cast("array<long>").alias("place"))
    front = cut(start)
    chosen = front.select(_CHOSEN)
    used: list[DataFrame] = []
    for depth in itertools.count(1):
        have = chosen.select("target", F.col("id").alias("dependency"), F.col("version").alias("had"))
        asks = front.select("target", "id", "place").join(deps, "id").withColumn("place", F.concat("place", F.array(F.col("ordinal").cast("long"))))
        asks = cut(asks.join(have, ["target", "dependency"], "left"))
        settles = asks.where("had is null and not (optional and best is null)")
        order = F.struct("place", "id", "constraint", "optional", "best", "known")
        firsts = settles.groupBy("target", "dependency").agg(F.min(order).alias("f"))
        j = cut(asks.join(firsts, ["target", "dependency"], "left"))
        is_first = (F.col("had").isNull() & (order == F.col("f"))).alias("is_first")
        later = F.col("had").isNotNull() | (order > F.col("f"))
        j = j.withColumns({"version": F.coalesce("had", "f.best"), "is_first": F.coalesce(is_first, F.lit(False)), "later": F.coalesce(later, F.lit(False))})
        wrong = F.when(F.col("is_first") & F.col("best").isNull(), F.when(F.col("known").isNull(), "missing").otherwise("conflict"))
        wrong = wrong.when(F.col("later") & ~_fits("constraint", "version"), "conflict")
        j = cut(j.withColumn("problem", wrong))
        failed = j.where("problem is not null").groupBy("target").agg(F.min(F.struct("place", "id", "dependency", "constraint", "problem")).alias("p"))
        failed = cut(failed.select("target", "p.id", "p.dependency", "p.constraint", "p.problem"))
        problems = problems.unionByName(failed)
        j = j.join(failed.select("target"), "target", "left_anti")
        used.append(j.where("is_first or later").select("target", F.col("id").alias("src"), F.col("dependency").alias("dst")))
        front = cut(j.where("is_first").select("target", F.col("dependency").alias("id"), F.col("best").alias("version"), F.lit(depth).alias("depth"), F.col("id").alias("requested_by"), "place"))
        if front.isEmpty():
            break
        chosen = cut(chosen.unionByName(front.select(_CHOSEN)))
    edges = used[0]
    for part in used[1:]:
        edges = edges.unionByName(part)
    return chosen, cut(edges.distinct()), problems.select(_PROBLEM)


def install_order(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, cyclic): in each target's plan what is needed comes before what needs it.

    nodes: (target, id); edges: (target, src, dst), src needing dst.  order: (target, id, place), places from 1: the
    order in which a depth-first walk leaves the ids, taking them and what they need by name.  That walk comes to an id by
    the least of all ways to it, so rounds of joins find it: a way is greater than those that branch off before it,
    and is left after all that continue it.  cyclic: (target), plans with a cycle, a self-reference too; these have no
    order.  A round for each id of the longest way; places are counted by ranges, not by one task a plan.
    """
    n = nodes.select("target", "id").where("target is not null and id is not null").distinct()
    e = edges.select("target", "src", "dst").distinct()
    e = e.join(n.withColumnRenamed("id", "src"), ["target", "src"], "left_semi")
    e = cut(e.join(n.withColumnRenamed("id", "dst"), ["target", "dst"], "left_semi"))
    best = front = cut(n.withColumn("way", F.array("id")))
    cyclic = n.select("target").limit(0)
    while True:
        step = cut(front.join(e, (front["target"] == e["target"]) & (front["id"] == e["src"])).select(front["target"], "dst", "way"))
        back = cut(step.where(F.array_contains("way", F.col("dst"))).select("target").distinct())
        cyclic = cut(cyclic.unionByName(back).distinct())
        on = step.join(cyclic, "target", "left_anti").select("target", F.col("dst").alias("id"), F.array_append("way", F.col("dst")).alias("way"))
        least = on.groupBy("target", "id").agg(F.min("way").alias("_w"))
        grown = cut(best.join(cyclic, "target", "left_anti").join(least, ["target", "id"], "left").select("target", "id", F.least("way", "_w").alias("way"), F.coalesce(F.col("_w") < F.col("way"), F.lit(False)).alias("better")))
        best, front = grown.select("target", "id", "way"), grown.where("better").select("target", "id", "way")
        if front.isEmpty():
            break
    # Nothing sorts after the end of a way.
    item = lambda last, c: F.struct(F.lit(last).alias("last"), c.alias("id"))
    key = F.array_append(F.transform("way", lambda x: item(0, x)), item(1, F.lit("")))
    dealt = cut(best.select("target", "id", key.alias("key")).repartitionByRange("target", "key").withColumn("part", F.spark_partition_id()))
    per = dealt.groupBy("target", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("target").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("target", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("target", "part").orderBy("key"))
    order = dealt.withColumn("_w", within).join(per, ["target", "part"]).select("target", "id", (F.col("_before") + F.col("_w")).alias("place"))
    return order, cyclic


def plans(targets: DataFrame, catalog: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(target, id, version, place, problem): a plan's rows in the order to install them, or one row with what is wrong.

    The id of a problem is the dependency that can't be had; a plan without a problem else may have a cycle.
    """
    chosen, used, problems = select_versions(targets, catalog, dependencies)
    good = cut(chosen.join(problems.select("target"), "target", "left_anti"))
    order, cyclic = install_order(good, used)
    none = lambda kind: F.lit(None).cast(kind)
    bad = problems.select("target", F.col("dependency").alias("id"), "problem").unionByName(cyclic.select("target", none("string").alias("id"), F.lit("cycle").alias("problem")))
    rows = order.join(good.select("target", "id", "version"), ["target", "id"]).select("target", "id", "version", "place", none("string").alias("problem"))
    return rows.unionByName(bad.select("target", "id", none("string").alias("version"), none("long").alias("place"), "problem"))
