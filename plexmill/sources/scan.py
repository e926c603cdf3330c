"""Repository scans: file rows, languages, version-control logs, snapshots."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as X

#: Fixed values.
IGNORED = [".git", ".svn", ".hg", ".idea", ".vscode", "node_modules", "vendor", ".cache", ".DS_Store", "Thumbs.db"]
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".rs": "rust", ".c": "c",
    ".cpp": "cpp", ".rb": "ruby", ".php": "php", ".sh": "shell", ".md": "markdown", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".html": "html", ".css": "css", ".sql": "sql",
}
LANGUAGE_FILES = {"Makefile": "make", "Dockerfile": "dockerfile", "go.mod": "go"}


def effective_root(start: str) -> str:
    """The nearest directory upwards that holds .git, else the start."""
    here = Path(start).resolve()
    for d in (here, *here.parents):
        if (d / ".git").exists():
            return str(d)
    return str(here)


def _matched(column: Column, dim: dict[str, str]) -> Column:
    out = None
    for k, v in dim.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def language(path: Column) -> Column:
    """By whole file name, else by extension."""
    return F.coalesce(_matched(X.base_name(path), LANGUAGE_FILES), _matched(X.extension(path), LANGUAGES))


def is_test(path: Column) -> Column:
    return path.rlike(r"(_test\.go|\.test\.[jt]s|\.spec\.[jt]s|(^|/)test_[^/]*\.py)$") | X.any_segment_in(path, ["test", "tests"])


def scan(spark: SparkSession, root: str, ignored: list[str] | None = None, hidden: bool = False, max_depth: int = 0, max_files: int = 0, contents: bool = True) -> DataFrame:
    """Rows of the files under `root`: path, size, mod_time, extension, language, is_test, is_hidden (and content).

    Ignored directories are dropped before contents are read; with `max_files` the
    first ones in path order stay.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = Path(root).resolve().as_posix().rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "") if "://" not in root else F.col("path")
    rows = raw.withColumn("path", F.expr(f"substring(path, {len(base) + 1})") if "://" in root else F.replace(path, F.lit(base), F.lit("")))
    rows = rows.where(~X.any_segment_in(F.col("path"), IGNORED if ignored is None else ignored))
    rows = rows.withColumn("is_hidden", F.col("path").rlike(r"(^|/)\.[^/]"))
    if not hidden:
        rows = rows.where(~F.col("is_hidden"))
    if max_depth:
        rows = rows.where(F.size(F.split("path", "/")) <= max_depth)
    rows = rows.select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mod_time"),
        X.extension(F.col("path")).alias("extension"),
        language(F.col("path")).alias("language"),
        is_test(F.col("path")).alias("is_test"),
        "is_hidden",
        *(["content"] if contents else []),
    )
    return rows.orderBy("path").limit(max_files) if max_files else rows


def inspect(files: DataFrame) -> DataFrame:
    """`files` with hash, encoding, line ending, line counts, generated mark and kind in place of content."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    enc = C.encoding(F.col("content"))
    counts = C.line_counts(text)
    return files.withColumn("_l", counts).select(
        *[c for c in files.columns if c != "content"],
        C.content_hash(F.col("content")).alias("content_hash"),
        enc.alias("encoding"),
        C.line_ending(text).alias("line_ending"),
        F.col("_l.total").alias("lines"),
        F.col("_l.blank").alias("blank_lines"),
        F.col("_l.comment").alias("comment_lines"),
        C.is_generated(text).alias("is_generated"),
        C.file_kind(F.col("path"), F.col("language"), F.col("is_test"), enc).alias("kind"),
    )


def changed(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose (path, content_hash) isn't in the previous snapshot: the only ones to parse again."""
    return files.join(previous.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def language_distribution(files: DataFrame) -> DataFrame:
    """(language, files, bytes, extensions, percent), most files first."""
    per = files.where("language is not null").groupBy("language").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sort_array(F.collect_set("extension")).alias("extensions")
    )
    share = F.col("files") * 100.0 / F.sum("files").over(Window.partitionBy())
    return per.withColumn("percent", share).orderBy(F.desc("files"), F.desc("bytes"), "language")


def reflog(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, old, new, author, email, ts, message) of a reflog file."""
    form = r"^(\S+) (\S+) (.*) <([^>]*)> (\d+) ([+-]\d{4})\t?(.*)$"
    part = lambda i: F.regexp_extract("value", form, i)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ordinal", "value"))
    return lines.where(F.col("value").rlike(form)).select(
        "ordinal", part(1).alias("old"), part(2).alias("new"), part(3).alias("author"), part(4).alias("email"),
        F.timestamp_seconds(part(5).cast("long")).alias("ts"), part(7).alias("message"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author", "email").agg(F.count("*").alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def commit_stats(commits: DataFrame) -> DataFrame:
    """One row; the first and last hashes follow file order, the times follow the clock."""
    return commits.agg(
        F.count("*").alias("commits"), F.min_by("new", "ordinal").alias("first_sha"), F.max_by("new", "ordinal").alias("last_sha"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def packed_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag, sha) of a packed-refs file; the peeled hash of an annotated tag counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    w = Window.orderBy("n")
    nxt = F.lead("value").over(w)
    return lines.withColumn("peeled", F.when(nxt.startswith("^"), F.substring(nxt, 2, 64))).where(F.col("value").contains(" refs/tags/")).select(
        F.regexp_extract("value", r" refs/tags/(.*)$", 1).alias("tag"),
        F.coalesce("peeled", F.regexp_extract("value", r"^(\S+)", 1)).alias("sha"),
    )


def releases(tags: DataFrame) -> DataFrame:
    """Tags that look like versions, and their prerelease kind."""
    kind = F.regexp_extract(F.lower("tag"), r"(alpha|beta|rc|preview|dev)", 1)
    return tags.where(F.col("tag").rlike(r"^v?\d+(\.\d+)*")).withColumn("prerelease", F.nullif(kind, F.lit("")))


def read_snapshot(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """JSON lines whose schema_version is `version`; any other version or a corrupt line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    other = F.assert_true(F.col("schema_version") == version, F.lit("another schema version"))
    return rows.where(other.isNull())
