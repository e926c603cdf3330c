"""Strongly connected components by elimination and colouring, and longest paths over them.

A node without a way in or out is a component of its own.  A node with one way in (or out)
can be taken off and its edges handed to that neighbour without changing who reaches whom
among the others; it belongs to the neighbour's component just if an edge on its other side
does.  Each round takes off an independent set of such nodes, a share of all of them, so
chains and rings of n nodes go in the logarithm of n rounds, and edges only become fewer.
What is left has two ways in and out at every node; there the greatest node that reaches
each is its colour, and the nodes of a colour that reach its namesake are a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import written as cut


def _degrees(e: DataFrame) -> DataFrame:
    """(id, ins, outs, one_in, one_out) of the nodes of distinct edges."""
    ways = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(e.schema["src"].dataType).alias("a"), F.col("dst").alias("b"))
    ways = ways.unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("a"), F.lit(None).cast(e.schema["dst"].dataType).alias("b")))
    return ways.groupBy("id").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.min("a").alias("one_in"), F.min("b").alias("one_out"))


def _independent(e: DataFrame, d: DataFrame, salt: int) -> DataFrame:
    """(id, anchor, inward) of nodes to be taken off, no two of them neighbours: those that draw more than all such neighbours."""
    draw = F.struct(F.xxhash64(F.lit(salt), "id"), F.col("id"))
    can = d.where("ins = 1 or outs = 1").select("id", F.when(F.col("ins") == 1, F.col("one_in")).otherwise(F.col("one_out")).alias("anchor"), (F.col("ins") == 1).alias("inward"), draw.alias("draw"))
    ends = e.join(can.select(F.col("id").alias("src"), F.col("draw").alias("s")), "src").join(can.select(F.col("id").alias("dst"), F.col("draw").alias("t")), "dst")
    beaten = ends.select(F.when(F.col("s") < F.col("t"), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()
    return can.drop("draw").join(beaten, "id", "left_anti")


def _colours(e: DataFrame) -> DataFrame:
    """(id, component): at least one component of a graph without nodes to trim, found by its greatest node."""
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    colour = cut(ids.withColumn("colour", F.col("id")))
    new = colour
    while not new.isEmpty():
        step = new.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("_c"))
        grown = cut(colour.join(step, "id", "left").select("id", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("grew")))
        new = grown.where("grew").select("id", "colour")
        colour = grown.select("id", "colour")
    a, b = (colour.select(F.col("id").alias(end), F.col("colour").alias(c)) for end, c in (("src", "_a"), ("dst", "_b")))
    back = cut(e.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst"))
    found = new = cut(colour.where("id = colour"))
    while True:
        step = new.join(back, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "colour").distinct()
        new = cut(step.join(found, ["id", "colour"], "left_anti"))
        if new.isEmpty():
            return found.select("id", F.col("colour").alias("component"))
        found = cut(found.unionByName(new))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge (src, dst): the smallest node of its strongly connected component.

    Null ends are left out; an edge from a node to itself joins nothing; repeated edges count once; without
    edges there is no row.
    """
    whole = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    e = whole.where("src <> dst")
    known: list[DataFrame] = []
    taken: list[DataFrame] = []
    for salt in range(1 << 30):
        if e.isEmpty():
            break
        d = cut(_degrees(e))
        ends = d.where("ins = 0 or outs = 0").select("id")
        known.append(ends.select("id", F.col("id").alias("component")))
        off = _independent(e, d.where("ins > 0 and outs > 0"), salt).join(ends.withColumnRenamed("id", "anchor"), "anchor", "left_anti").select("id", "anchor", "inward")
        gone = cut(off.unionByName(ends.select("id", F.lit(None).cast(whole.schema["src"].dataType).alias("anchor"), F.lit(None).cast("boolean").alias("inward"))))
        if gone.isEmpty():  # two ways in and out everywhere
            coloured = _colours(cut(e))
            known.append(coloured)
            gone = coloured.select("id", F.lit(None).cast(whole.schema["src"].dataType).alias("anchor"), F.lit(None).cast("boolean").alias("inward"))
        s = gone.select(F.col("id").alias("src"), F.col("anchor").alias("sa"), F.col("inward").alias("si"), F.lit(True).alias("sg"))
        t = gone.select(F.col("id").alias("dst"), F.col("anchor").alias("ta"), F.col("inward").alias("ti"), F.lit(True).alias("tg"))
        j = cut(e.join(s, "src", "left").join(t, "dst", "left"))
        # The edges of a node taken off, on the side away from its anchor.
        away = j.where("si").select(F.col("src").alias("id"), F.col("sa").alias("anchor"), F.col("dst").alias("other"))
        taken.append(away.unionByName(j.where("not ti").select(F.col("dst").alias("id"), F.col("ta").alias("anchor"), F.col("src").alias("other"))))
        left = j.where("sg is null and tg is null").select("src", "dst")
        handed = j.where("si and tg is null").select(F.col("sa").alias("src"), "dst").unionByName(j.where("not ti and sg is null").select("src", F.col("ta").alias("dst")))
        e = cut(left.unionByName(handed).where("src <> dst").distinct())
    ids = whole.select(F.col("src").alias("id")).unionByName(whole.select(F.col("dst").alias("id"))).distinct()
    none = ids.select("id", F.col("id").alias("component")).limit(0)
    comp = none
    for part in known:
        comp = comp.unionByName(part)
    comp = cut(comp)
    for rows in reversed(taken):
        a = comp.select(F.col("id").alias("anchor"), F.col("component").alias("_a"))
        o = comp.select(F.col("id").alias("other"), F.col("component").alias("_o"))
        # Ends that were taken off in no round, and hold no other edge, are components of their own.
        j = rows.join(a, "anchor", "left").join(o, "other", "left").withColumns({"_a": F.coalesce("_a", "anchor"), "_o": F.coalesce("_o", "other")})
        own = j.groupBy("id").agg(F.max(F.when(F.col("_a") == F.col("_o"), F.col("_a"))).alias("c"))
        comp = cut(comp.unionByName(own.select("id", F.coalesce("c", "id").alias("component"))))
    comp = ids.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    least = comp.groupBy("component").agg(F.min("id").alias("_least"))
    return cut(comp.join(least, "component").select("id", F.col("_least").alias("component")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes on a cycle of two edges or more, which are those of components of two nodes or more."""
    comp = strong_components(edges)
    large = comp.groupBy("component").count().where("count > 1").select("component")
    return comp.join(large, "component", "left_semi").select("id")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, n): how many edges lead from one component to another; without cycles."""
    a, b = (components.select(F.col("id").alias(end), F.col("component").alias(c)) for end, c in (("src", "_a"), ("dst", "_b")))
    got = edges.join(a, "src").join(b, "dst").where("_a <> _b").groupBy("_a", "_b").agg(F.count("*").alias("n"))
    return got.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "n")


def longest_path(edges: DataFrame, start: str, most: int) -> DataFrame:
    """One row (depth): edges of the longest simple path from `start`, at most `most`.

    A simple path that leaves a component never comes back.  So simple paths are listed inside components
    only, from the nodes where they are entered; between components the greatest length of a way to each node
    is carried along, a row for each node however many ways there are.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    spark = edges.sparkSession
    first = spark.range(1).select(F.lit(start).cast(e.schema["src"].dataType).alias("id"))
    reached = new = cut(first)
    for _ in range(most):
        new = cut(new.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti"))
        if new.isEmpty():
            break
        reached = cut(reached.unionByName(new))
    e = cut(e.join(reached.select(F.col("id").alias("src")), "src", "left_semi").join(reached.select(F.col("id").alias("dst")), "dst", "left_semi"))
    comp = strong_components(e)
    a, b = (comp.select(F.col("id").alias(end), F.col("component").alias(c)) for end, c in (("src", "_a"), ("dst", "_b")))
    sided = cut(e.join(a, "src").join(b, "dst"))
    between = sided.where("_a <> _b").select("src", "dst")
    inside = sided.where("_a = _b").select("src", "dst")
    entered = between.select(F.col("dst").alias("id")).unionByName(first).distinct().join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    paths = cut(entered.select(F.col("id").alias("entry"), F.col("id").alias("node"), F.array("id").alias("path")))
    within = []
    for n in range(1, most + 1):
        step = paths.join(inside, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = cut(step.select("entry", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        if paths.isEmpty():
            break
        within.append(paths.select("entry", "node").distinct().withColumn("length", F.lit(n)))
    ways = entered.select(F.col("id").alias("entry"), F.col("id").alias("node"), F.lit(0).alias("length"))
    for part in within:
        ways = ways.unionByName(part)
    ways = cut(ways.groupBy("entry", "node").agg(F.max("length").alias("length")))

    def spread(at: DataFrame) -> DataFrame:
        """Nodes entered to nodes of their component."""
        j = at.join(ways, F.col("id") == F.col("entry"), "left")
        far = F.least(F.lit(most), F.col("depth") + F.coalesce("length", F.lit(0)))
        return j.select(F.coalesce("node", "id").alias("id"), far.alias("depth")).groupBy("id").agg(F.max("depth").alias("depth"))

    best = new = cut(spread(first.withColumn("depth", F.lit(0))))
    while True:
        step = new.where(F.col("depth") < most).join(between, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg((F.max("depth") + 1).alias("depth"))
        new = cut(spread(step).join(best.withColumnRenamed("depth", "_best"), "id", "left").where("_best is null or depth > _best").select("id", "depth"))
        if new.isEmpty():
            return best.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
        best = cut(best.unionByName(new).groupBy("id").agg(F.max("depth").alias("depth")))
