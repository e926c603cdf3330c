"""Catalogue search, featured, trending and recommended items, ratings, and version selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def catalog_search(items: DataFrame, query: str = "", category: str = "", publisher: str = "", tags: tuple[str, ...] = (), featured: bool = False, min_rating: float = 0.0, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of matches, best first, with `total`, their number before paging."""
    got = items
    if category:
        got = got.where(F.array_contains("categories", category))
    if publisher:
        got = got.where(F.col("publisher") == publisher)
    for t in tags:
        got = got.where(F.array_contains("tags", t))
    if featured:
        got = got.where("featured")
    if min_rating:
        got = got.where(F.col("average_rating") >= min_rating)
    words = [w for w in query.lower().split() if w]
    s = X.relevance(words, F.col("id"), F.col("name"), F.col("description"), F.col("tags"), F.col("publisher"))
    hits = got.withColumn("relevance", s).where("relevance > 0")
    total = hits.agg(F.count("*").alias("total"))
    return (
        hits.join(F.broadcast(total))
        .orderBy(F.desc("relevance"), F.desc("downloads"), "id")
        .offset(max(0, offset))
        .limit(min(max(1, limit), 100))
    )


def featured(items: DataFrame, limit: int) -> DataFrame:
    """Featured items first, then those rated 4 or more."""
    tier = F.when(F.col("featured"), 0).when(F.col("average_rating") >= 4, 1)
    return items.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("average_rating"), "id").limit(limit)


def trending(items: DataFrame, downloads: DataFrame, asof: str, days: int = 7, limit: int = 10) -> DataFrame:
    """By 10 * recent downloads + 0.05 * downloads (0.7 * without recent ones) + 0.3 * rating * ratings."""
    since = F.lit(asof).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    recent = downloads.where((F.col("ts") > since) & (F.col("ts") <= F.lit(asof).cast("timestamp_ntz"))).groupBy("id").agg(F.count("*").alias("velocity"))
    v = F.coalesce("velocity", F.lit(0))
    score = F.when(v > 0, 10.0 * v + 0.05 * F.col("downloads")).otherwise(0.7 * F.col("downloads")) + 0.3 * F.col("average_rating") * F.col("rating_count")
    return items.join(recent, "id", "left").select("id", v.alias("velocity"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def recommended(items: DataFrame, target: str, limit: int = 10) -> DataFrame:
    """Items like one: 5 for each shared category, 3 for each shared tag, 2 for the publisher, 1.5 for quality.

    Elements count as often as they occur.  The item itself is one row.
    """
    own = items.where(F.col("id") == target).select(
        F.col("categories").alias("_c"), F.col("tags").alias("_t"), F.col("publisher").alias("_p")
    ).limit(1)
    shared = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    score = (
        5.0 * shared("categories", F.col("_c")) + 3.0 * shared("tags", F.col("_t"))
        + F.when(F.col("publisher") == F.col("_p"), 2.0).otherwise(0.0) + F.when(F.col("average_rating") >= 4, 1.5).otherwise(0.0)
    )
    got = items.where(F.col("id") != target).join(F.broadcast(own)).withColumn("score", score).where("score > 0")
    return got.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def rating_summary(ratings: DataFrame, key: str) -> DataFrame:
    """(key, average to one place, n, stars): the sum skips values outside 1 to 5, the divisor doesn't."""
    ok = F.col("rating").between(1, 5)
    stars = F.map_from_arrays(F.array(*[F.lit(i) for i in range(1, 6)]), F.array(*[F.count_if(F.col("rating") == i) for i in range(1, 6)]))
    return ratings.groupBy(key).agg(
        F.round(F.sum(F.when(ok, F.col("rating")).otherwise(0)) / F.count("*"), 1).alias("average"),
        F.count("*").alias("n"),
        stars.alias("stars"),
    )


def category_breakdown(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, n) for every category, those without items too."""
    n = items.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return categories.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def best_versions(wanted: DataFrame, versions: DataFrame, parse, satisfies) -> DataFrame:
    """(dependency, version): the highest version that meets every constraint on it; null if none does."""
    per = wanted.groupBy("dependency").agg(F.collect_set("constraint").alias("cs"))
    joined = per.join(versions, "dependency", "left")
    fits = F.forall("cs", lambda c: satisfies(c, parse(F.col("version"))))
    return joined.groupBy("dependency").agg(F.max_by(F.when(fits, F.col("version")), F.when(fits, parse(F.col("version")))).alias("version"))


def running_files(points: DataFrame, key: str) -> DataFrame:
    """Running count of added - removed, never below zero, by key over time (ts, added, removed)."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumn("_s", F.sum(F.col("added") - F.col("removed")).over(w))
    return run.withColumn("files", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def inventory(uses: DataFrame, item: str, consumer: str, kind: str) -> DataFrame:
    """(item, consumers, uses, kinds) of each item used."""
    return uses.groupBy(item).agg(F.countDistinct(consumer).alias("consumers"), F.count("*").alias("uses"), F.countDistinct(kind).alias("kinds"))


def evolution(commits: DataFrame, message: str = "message", most: int = 5) -> DataFrame:
    """(ordinal, ts, added, removed, structural, note) of commits (ordinal, ts, added, removed, message): an expansion of the
    structure is one of more than `most` files added or removed, and has its message as note."""
    large = (F.col("added") > most) | (F.col("removed") > most)
    return commits.select("ordinal", "ts", "added", "removed", large.alias("structural"), F.when(large, F.col(message)).alias("note"))


def growth(commits: DataFrame, files: int, packages: int) -> DataFrame:
    """One row (commits, file_rate, package_rate): what is there now for each commit; zero with fewer than two commits."""
    n = F.count("*")
    rate = lambda x: F.when(n > 1, F.lit(float(x)) / n).otherwise(0.0)
    return commits.agg(n.alias("commits"), rate(files).alias("file_rate"), rate(packages).alias("package_rate"))
