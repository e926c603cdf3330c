"""Findings, scores, insights, recommendations and risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import degrees, orphans

#: What a finding of each severity takes off a score, and the shares of the health score.
SEVERITY_WEIGHT = {"critical": 15.0, "high": 8.0, "medium": 4.0, "low": 1.0, "info": 0.2}
HEALTH_SHARES = {"engineering": 0.30, "architecture": 0.25, "maintainability": 0.20, "test": 0.15, "documentation": 0.10}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
LAYERS = [
    ("platform", 1), ("filesystem", 1), ("parser", 1), ("language", 1), ("capabilities/repository", 2), ("engine", 2), ("repository", 2),
    ("capabilities/intelligence", 3), ("cli", 4), ("cmd", 4),
]
MANDATORY_KEYS = ["host", "database"]

_FINDING = ["rule", "severity", "target", "detail"]


def finding(df: DataFrame, rule: str, severity: str, target: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), target.cast("string").alias("target"), detail.cast("string").alias("detail")
    )


def finding_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, w in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_WEIGHT))
    for i, name in enumerate(SEVERITY_WEIGHT):
        out = F.when(severity == name, i).otherwise(out)
    return out


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Distinct findings, most severe first."""
    return findings.dropDuplicates(_FINDING).orderBy(severity_rank(F.col("severity")), "rule", "target", "detail")


def circular_dependencies(cycles: DataFrame) -> DataFrame:
    names = cycles.select(X.canonical_cycle(F.col("cycle")).alias("c")).distinct()
    return finding(names, "circular_dependency", "critical", F.col("c"), F.col("c"))


def layer(path: Column) -> Column:
    """Rank of the first listed layer whose name occurs in the path, in any case, else 0."""
    path, out = F.lower(path), None
    for name, rank in LAYERS:
        out = F.when(path.contains(name), rank) if out is None else out.when(path.contains(name), rank)
    return out.otherwise(0)


def layer_violations(comms: DataFrame) -> DataFrame:
    s, t = layer(F.col("src")), layer(F.col("tgt"))
    bad = comms.where((s > 0) & (t > 0) & (s < t)).select("src", "tgt").distinct()
    return finding(bad, "layer_violation", "high", F.col("src"), F.col("tgt"))


def tight_coupling(comms: DataFrame, traffic: int = 15, fan_out: int = 15) -> DataFrame:
    """Pairs with traffic both ways above `traffic` in sum, and sources of more than `fan_out` rows.

    comms: (src, tgt, weight), weight being the symbols and calls of the row.
    """
    pair = comms.groupBy("src", "tgt").agg(F.sum("weight").alias("w"))
    back = pair.select(F.col("src").alias("tgt"), F.col("tgt").alias("src"), F.col("w").alias("w_back"))
    both = pair.join(back, ["src", "tgt"]).where((F.col("src") < F.col("tgt")) & (F.col("w_back") > 0) & (F.col("w") + F.col("w_back") > traffic))
    wide = comms.where(~F.col("src").rlike("cmd|cli")).groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > fan_out)
    return finding(both, "tight_coupling", "high", F.concat_ws("<->", "src", "tgt"), F.col("w") + F.col("w_back")).unionByName(
        finding(wide, "high_fan_out", "medium", F.col("src"), F.col("n"))
    )


def orphan_packages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = orphans(nodes, edges).where(~F.col("id").rlike("cmd|test|tools"))
    return finding(bad, "orphan_package", "low", F.col("id"), F.lit("no edges"))


def duplicate_groups(df: DataFrame, key: str, text: Column, least_bytes: int = 25) -> DataFrame:
    """(hash, n, representative): groups of equal texts of some length."""
    return (
        df.where(F.octet_length(text) >= least_bytes)
        .groupBy(F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("hash"))
        .agg(F.count("*").alias("n"), F.min(key).alias("representative"))
        .where("n > 1")
    )


def large_files(files: DataFrame, most: int = 40_000) -> DataFrame:
    return finding(files.where(F.col("size") > most), "large_file", "medium", F.col("path"), F.col("size"))


def package_cohesion(symbols: DataFrame, most_symbols: int = 50, most_files: int = 10) -> DataFrame:
    per = symbols.groupBy("package").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    bad = per.where((F.col("n") > most_symbols) & (F.col("files") > most_files))
    return finding(bad, "package_cohesion", "medium", F.col("package"), F.concat_ws("/", "n", "files"))


def module_boundaries(comms: DataFrame) -> DataFrame:
    bad = comms.where(F.col("tgt").contains("internal") & (X.first_segment(F.col("src")) != X.first_segment(F.col("tgt"))))
    return finding(bad.select("src", "tgt").distinct(), "module_boundary", "high", F.col("src"), F.col("tgt"))


def configuration(entries: DataFrame) -> DataFrame:
    """Blank mandatory keys, keys repeated in a file, and keys whose values differ between files.

    entries: (key, value, file, ordinal); of a key repeated in a file the last value counts.
    """
    blank = entries.where(F.lower("key").isin(MANDATORY_KEYS) & (F.trim(F.coalesce("value", F.lit(""))) == ""))
    twice = entries.groupBy("file", "key").agg(F.count("*").alias("n")).where("n > 1")
    last = entries.groupBy("key", "file").agg(F.max_by("value", "ordinal").alias("value"))
    differ = last.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values")).where("n > 1 and values > 1")
    parts = [
        finding(blank, "invalid_configuration", "high", F.col("key"), F.col("file")),
        finding(twice, "duplicate_configuration", "medium", F.col("key"), F.col("file")),
        finding(differ, "configuration_conflict", "medium", F.col("key"), F.concat(F.col("values"), F.lit(" values"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def score(findings: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """One row: 100 less the weights of the findings, 0 to 100."""
    got = findings.where(F.col("rule").isin(rules)) if rules else findings
    total = F.coalesce(F.sum(severity_weight(F.col("severity"))), F.lit(0.0))
    return got.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total)).alias("score"))


def grade(value: Column) -> Column:
    out = None
    for least, name in GRADES:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise("F")


def documentation_score(documented: Column, exported: Column, has_docs: Column) -> Column:
    return 70.0 * F.when(exported > 0, documented / exported).otherwise(0.0) + F.when(has_docs, 30.0).otherwise(0.0)


def test_score(with_tests: Column, packages: Column, tests: Column, sources: Column) -> Column:
    a = F.when(packages > 0, with_tests / packages).otherwise(0.0)
    b = F.when(sources > 0, F.least(F.lit(1.0), tests / sources)).otherwise(0.0)
    return 60.0 * a + 40.0 * b


def health(dimensions: DataFrame) -> DataFrame:
    """(score, grade) from rows (dimension, score)."""
    share = F.lit(0.0)
    for name, w in HEALTH_SHARES.items():
        share = F.when(F.col("dimension") == name, w).otherwise(share)
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum(share * F.col("score"))))
    return dimensions.agg(F.round(total, 6).alias("score")).withColumn("grade", grade(F.col("score")))


def insights(nodes: DataFrame, edges: DataFrame, most_degree: int = 20, most_fan_out: int = 10, most_fan_in: int = 8) -> DataFrame:
    """(insight, id, n): nodes of high degree, and of high dependency fan-out and fan-in."""
    d = degrees(nodes, edges)
    dep = degrees(nodes, edges.where(F.col("kind").isin("depends_on", "imports")))
    high = d.where(F.col("in_degree") + F.col("out_degree") > most_degree)
    row = lambda df, name, n: df.select(F.lit(name).alias("insight"), "id", n.alias("n"))
    return (
        row(high, "high_degree", F.col("in_degree") + F.col("out_degree"))
        .unionByName(row(dep.where(F.col("out_degree") > most_fan_out), "fan_out", F.col("out_degree")))
        .unionByName(row(dep.where(F.col("in_degree") > most_fan_in), "fan_in", F.col("in_degree")))
    )


def recommendations(nodes: DataFrame, edges: DataFrame, fan_out: int = 8, callers: int = 10) -> DataFrame:
    """(rule, priority, id): two-node cycles, wide fan-out, orphans, and nodes with many callers."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = e.join(back, ["src", "dst"]).where("src < dst").select(F.concat_ws("<->", "src", "dst").alias("id"))
    wide = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= fan_out)
    hot = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= callers)
    row = lambda df, rule, p: df.select(F.lit(rule).alias("rule"), F.lit(p).alias("priority"), "id")
    return (
        row(pairs, "break_cycle", "critical")
        .unionByName(row(wide, "reduce_fan_out", "high"))
        .unionByName(row(orphans(nodes, edges), "remove_orphan", "low"))
        .unionByName(row(hot, "stabilise_interface", "medium"))
    )


def risk(nodes: DataFrame, edges: DataFrame, group: Column, exported: Column) -> DataFrame:
    """(id, score, tier) for all nodes at once.

    2 for each inbound edge, 5 for each from another group, 10 if exported, and the
    out-degree where it is above 5; tiers at 30, 15 and 5.
    """
    named = nodes.select("id", group.alias("_g"), exported.alias("_x"))
    src = named.select(F.col("id").alias("src"), F.col("_g").alias("_gs"))
    dst = named.select(F.col("id").alias("dst"), F.col("_g").alias("_gd"))
    inbound = (
        edges.join(src, "src").join(dst, "dst").groupBy(F.col("dst").alias("id"))
        .agg(F.count("*").alias("n_in"), F.count_if(F.col("_gs") != F.col("_gd")).alias("n_cross"))
    )
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = 2 * z("n_in") + 5 * z("n_cross") + F.when(F.col("_x"), 10).otherwise(0) + F.when(z("n_out") > 5, z("n_out")).otherwise(0)
    got = named.join(inbound, "id", "left").join(out, "id", "left").select("id", total.cast("long").alias("score"))
    tier = F.when(F.col("score") >= 30, "critical").when(F.col("score") >= 15, "high").when(F.col("score") >= 5, "medium").otherwise("low")
    return got.withColumn("tier", tier)


def safety(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, delete, extract): a node with inbound use can't be deleted; above 15 calls out it can't be extracted."""
    d = degrees(nodes, edges.where(F.col("kind").isin("calls", "depends_on", "imports", "implements")))
    return d.select(
        "id",
        F.when(F.col("in_degree") > 0, "blocked").otherwise("safe").alias("delete"),
        F.when(F.col("out_degree") > 15, "blocked").otherwise("safe").alias("extract"),
    )


def rename_safety(nodes: DataFrame, edges: DataFrame, target: str, new_name: str) -> DataFrame:
    """One row (collision, inbound, loses_export, verdict)."""
    collision = nodes.where(F.col("name") == new_name).agg((F.count("*") > 0).alias("collision"))
    inbound = edges.where(F.col("dst") == target).agg(F.count("*").alias("inbound"))
    own = nodes.where(F.col("id") == target).agg(F.bool_or(F.col("name").rlike("^[A-Z]")).alias("was"))
    row = collision.join(inbound).join(own)
    loses = F.coalesce(F.col("was"), F.lit(False)) & F.lit(not new_name[:1].isupper())
    verdict = F.when(F.col("collision"), "blocked").when((F.col("inbound") > 0) | loses, "unsafe").otherwise("safe")
    return row.select("collision", "inbound", loses.alias("loses_export"), verdict.alias("verdict"))
