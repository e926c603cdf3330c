"""Facts of version-controlled repositories, and manifests of plugins."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
DEFAULT_BRANCHES = ["main", "master"]
MANIFESTS = ["plugin.json"]
MANIFEST_SCHEMA = "id string, name string, version string, description string"


def packed_ref(text: str, ref: str) -> str:
    """The hash that a packed-refs file has for a ref, "" without one."""
    for line in text.splitlines():
        sha, _, name = line.partition(" ")
        if name.strip() == ref and not line.startswith(("#", "^")):
            return sha
    return ""


def facts(spark: SparkSession, root: str) -> DataFrame:
    """One row (root, is_git, branch, default_branch, commit): what a handful of small files under .git say.

    A detached HEAD has HEAD as branch; a branch's hash comes from its own file, else from the
    packed refs; the default branch is the remote's, else the first of the usual names that is there.
    """
    git = Path(root) / ".git"
    read = lambda *p: git.joinpath(*p).read_text(errors="replace").strip() if git.joinpath(*p).is_file() else ""
    branch = commit = default = ""
    if git.is_dir():
        head, packed = read("HEAD"), read("packed-refs")
        if head.startswith("ref: "):
            ref = head.removeprefix("ref: ")
            branch = ref.removeprefix("refs/heads/")
            commit = read(ref) or packed_ref(packed, ref)
        elif len(head) in (40, 64):
            branch, commit = "HEAD", head
        remote = read("refs", "remotes", "origin", "HEAD").removeprefix("ref: ").removeprefix("refs/remotes/origin/")
        there = [b for b in DEFAULT_BRANCHES if read("refs", "heads", b) or packed_ref(packed, f"refs/heads/{b}")]
        default = remote or next(iter(there), "")
    row = (str(root), git.is_dir(), branch, default, commit)
    return spark.createDataFrame([row], "root string, is_git boolean, branch string, default_branch string, commit string")


def tags(spark: SparkSession, root: str) -> DataFrame:
    """(tag, sha) of the tags that have files of their own under .git/refs/tags; `scan.packed_tags` has the others."""
    folder = Path(root) / ".git" / "refs" / "tags"
    rows = [(p.relative_to(folder).as_posix(), p.read_text().strip()) for p in sorted(folder.rglob("*")) if p.is_file()] if folder.is_dir() else []
    return spark.createDataFrame(rows, "tag string, sha string")


def owner_of_config(text: str) -> str:
    """Owner segment of the origin remote's url in a configuration file, "" without one."""
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            section = line
        elif section == '[remote "origin"]' and line.replace(" ", "").startswith("url="):
            url = line.partition("=")[2].strip().removesuffix(".git")
            rest = url.partition("://")[2].partition("/")[2] if "://" in url else url.partition(":")[2]
            parts = [p for p in rest.split("/") if p]
            return parts[-2] if len(parts) > 1 else ""
    return ""


def read_manifests(spark: SparkSession, folders: list[str], names: list[str] = MANIFESTS) -> DataFrame:
    """(folder_order, path, content) of the manifests in folders and in the folders right below them; missing ones are skipped."""
    out = spark.createDataFrame([], "folder_order int, path string, content string")
    for k, folder in enumerate(f for f in folders if f.strip() and Path(f).is_dir()):
        for name in names:
            for glob in (f"{folder}/{name}", f"{folder}/*/{name}"):
                if any(Path(folder).glob(glob.removeprefix(f"{folder}/"))):
                    got = spark.read.format("binaryFile").load(glob).select(F.lit(k).alias("folder_order"), "path", F.col("content").cast("string").alias("content"))
                    out = out.unionByName(got)
    return out


def manifests(files: DataFrame) -> DataFrame:
    """(id, name, version, path, state) of manifests (folder_order, path, content).

    The first of an id, by order of folders and then by path, is found; others are duplicate; a
    manifest that isn't JSON or has no id is invalid.
    """
    m = files.select("folder_order", "path", F.from_json("content", MANIFEST_SCHEMA).alias("m")).select("folder_order", "path", "m.id", "m.name", "m.version")
    valid = F.coalesce(F.trim("id"), F.lit("")) != ""
    first = m.where(valid).groupBy("id").agg(F.min(F.struct("folder_order", "path")).alias("_first"))
    j = m.join(first, "id", "left")
    state = F.when(~valid, "invalid").when(F.struct("folder_order", "path") == F.col("_first"), "found").otherwise("duplicate")
    return j.select("id", "name", "version", "path", state.alias("state"))
