"""Go sources read again after edits: files that didn't change aren't parsed, references that nothing moved aren't resolved.

What is kept between runs is a snapshot of three tables: files (path, content_hash), rows (`golang.declarations`) and
references (`golang.resolved`).  A snapshot is a folder that is written whole and never changed, so a lost executor or
a failed run leaves the one before as it was.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as X
from ..operators.rounds import dealt, written
from . import golang

#: What one package can see of another, without places in files.
_SEEN = ["what", "id", "name", "kind", "package_path", "receiver", "source", "candidate_id", "base_kind", "base", "path", "position"]


def cut(df: DataFrame) -> DataFrame:
    """`df` written once, as a side that is dealt out by key."""
    return dealt(written(df))


class Snapshot(NamedTuple):
    files: DataFrame
    rows: DataFrame
    references: DataFrame


def save(snapshot: Snapshot, folder: str) -> None:
    """Write a snapshot to a new folder."""
    for name, df in snapshot._asdict().items():
        df.write.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Snapshot:
    return Snapshot(*(dealt(spark.read.parquet(f"{folder}/{name}")) for name in Snapshot._fields))


def hashed(files: DataFrame) -> DataFrame:
    """(path, content_hash, content) of the .go files; a null content is an empty one."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return files.where(F.col("path").endswith(".go")).select("path", C.content_hash(content).alias("content_hash"), content.alias("content"))


def full(files: DataFrame) -> Snapshot:
    """A snapshot of files (path, content) from nothing; a path stands once."""
    rows = cut(golang.declarations(files))
    return Snapshot(cut(hashed(files).select("path", "content_hash")), rows, cut(golang.resolved(rows)))


def package_of(path: Column) -> Column:
    """The folder of a file."""
    return X.dir_name(path)


def seen(rows: DataFrame) -> DataFrame:
    """Distinct rows of `declarations` that other files may depend on: symbols, members, results and the package's variables."""
    of_others = rows.where("what in ('symbol', 'member', 'result') or (what = 'binding' and source = '')")
    return of_others.select(package_of(F.col("file_path")).alias("package"), *_SEEN).distinct()


def _keys(rows: DataFrame) -> DataFrame:
    """(key, package): names under which what a package declares is looked up."""
    name = F.col("name")
    variable = F.when(F.col("what") == "binding", F.array("name", F.when(F.col("package_path") == ".", name).otherwise(F.concat_ws(".", "package_path", "name"))))
    keys = F.coalesce(variable, F.array("id", "source", F.when(F.col("kind") == "method", golang._type_of(F.col("package_path"), F.col("receiver")))))
    return rows.select(F.explode(keys).alias("key"), "package").where("key <> ''").distinct()


def affected_packages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package): packages whose references may lead elsewhere after rows of `declarations` changed.

    These are the packages that others see changed, and in rounds those that mention what an affected one declares: a type may
    come from a package that its user never names, but then by way of one that it does.
    """
    old, new = seen(before), seen(after)
    changed = old.exceptAll(new).unionByName(new.exceptAll(old)).select("package").distinct()
    found = front = cut(changed)
    if front.isEmpty():
        return found
    names = F.explode(F.array("candidate_id", "method_id", "base", "source"))
    mention = before.unionByName(after).select(package_of(F.col("file_path")).alias("user"), names.alias("key")).where("key <> ''").distinct()
    uses = cut(dealt(mention).join(_keys(old.unionByName(new)), "key").where("user <> package").select("user", "package").distinct())
    while True:
        front = cut(front.join(uses, "package").select(F.col("user").alias("package")).distinct().join(found, "package", "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))


def update(files: DataFrame, previous: Snapshot) -> tuple[Snapshot, DataFrame]:
    """(snapshot, parsed) of files (path, content) after `previous`: the same rows as `full(files)` gives, in fewer steps.

    Only files whose (path, content_hash) the snapshot before lacks are parsed: edited, new and renamed ones; `parsed` are
    their (path).  References are resolved again in those files, and in all files of affected packages.
    """
    now = hashed(files)
    fresh = cut(now.join(previous.files, ["path", "content_hash"], "left_anti"))
    listed = cut(now.select("path", "content_hash"))
    parsed = fresh.select("path")
    same = listed.join(parsed, "path", "left_anti").select(F.col("path").alias("file_path"))
    rows = cut(previous.rows.join(same, "file_path", "left_semi").unionByName(golang.declarations(fresh)))
    packages = affected_packages(previous.rows, rows)
    again = rows.withColumn("package", package_of(F.col("file_path"))).join(packages, "package", "left_semi").select("file_path")
    again = cut(again.unionByName(parsed.withColumnRenamed("path", "file_path")).distinct())
    kept = previous.references.join(same, "file_path", "left_semi").join(again, "file_path", "left_anti")
    inside = "what = 'reference' or (what = 'binding' and source <> '')"
    asked = rows.where(f"not ({inside})").unionByName(rows.where(inside).join(again, "file_path", "left_semi").select(rows.columns))
    references = cut(kept.select(previous.references.columns).unionByName(golang.resolved(asked)))
    return Snapshot(listed, rows, references), parsed
