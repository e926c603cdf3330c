"""Semantic versions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a strict version.
_STRICT = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
_CONSTRAINT = r"^[\^~<>=]|\*|\|\|"


def parse_loose(raw: Column) -> Column:
    """struct(raw, major, minor, patch, prerelease, build, is_constraint, is_valid).

    Signs of a constraint and a v are left out at the front; what follows + is the build, and
    what follows the first - before that the prerelease; of the numbers between dots the
    first three count, and one that is no number is 0.  Valid if the first is a number.
    """
    clean = F.btrim(raw)
    bare = F.regexp_replace(clean, r"^[\^~>=<vV ]+", "")
    core = F.regexp_extract(bare, r"^([^+]*)", 1)
    parts = F.split(F.regexp_extract(core, r"^([^-]*)", 1), r"\.")
    number = lambda i: F.when(F.get(parts, i).rlike(r"^[+-]?\d{1,18}$"), F.get(parts, i).cast("long"))
    filled = clean != ""
    return F.struct(
        clean.alias("raw"),
        *(F.coalesce(number(i), F.lit(0)).alias(name) for i, name in enumerate(("major", "minor", "patch"))),
        F.regexp_extract(core, r"^[^-]*-(.*)$", 1).alias("prerelease"),
        F.regexp_extract(bare, r"^[^+]*\+(.*)$", 1).alias("build"),
        (filled & clean.rlike(_CONSTRAINT)).alias("is_constraint"),
        (filled & number(0).isNotNull()).alias("is_valid"),
    )


def parse(raw: Column) -> Column:
    """Comparable struct(major, minor, patch, release, prerelease), null unless strictly valid.

    A release is above its prereleases; prereleases compare as text; blanks around don't count.
    """
    raw = F.btrim(raw)
    part = lambda i: F.regexp_extract(raw, _STRICT, i)
    return F.when(
        raw.rlike(_STRICT),
        F.struct(
            part(1).cast("int").alias("major"),
            part(2).cast("int").alias("minor"),
            part(3).cast("int").alias("patch"),
            F.when(part(4) == "", 1).otherwise(0).alias("release"),
            part(4).alias("prerelease"),
        ),
    )


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compatible(have: Column, want: Column) -> Column:
    """0.x: same minor and patch not below; else same major and not below."""
    zero = (have["major"] == 0) & (want["major"] == 0)
    return F.when(zero, (have["minor"] == want["minor"]) & (have["patch"] >= want["patch"])).otherwise(
        (have["major"] == want["major"]) & (have >= want)
    )


def difference(a: Column, b: Column) -> Column:
    out = F.when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], "minor")
    return out.when(a["patch"] != b["patch"], "patch").when(a["prerelease"] != b["prerelease"], "prerelease").otherwise("none")


def release_kind(a: Column, b: Column) -> Column:
    """MAJOR, MINOR, and PATCH for everything else."""
    return F.when(a["major"] != b["major"], "MAJOR").when(a["minor"] != b["minor"], "MINOR").otherwise("PATCH")


def render(v: Column) -> Column:
    core = F.concat_ws(".", v["major"], v["minor"], v["patch"])
    return F.when(v["prerelease"] != "", F.concat(core, F.lit("-"), v["prerelease"])).otherwise(core)


def render_loose(v: Column) -> Column:
    """A loose version as text, prerelease and build included; one that isn't valid as it was given."""
    text = F.concat_ws(".", v["major"], v["minor"], v["patch"])
    text = F.concat(text, F.when(v["prerelease"] != "", F.concat(F.lit("-"), v["prerelease"])).otherwise(""))
    text = F.concat(text, F.when(v["build"] != "", F.concat(F.lit("+"), v["build"])).otherwise(""))
    return F.when(v["is_valid"], text).otherwise(v["raw"])


def satisfies(constraint: Column, version: Column) -> Column:
    """All comma-separated clauses hold; "", * and latest hold for any version.

    ^0.x asks for the same minor number, and ^0.0.x for the same patch, whatever the major one.
    """

    def clause(c: Column) -> Column:
        op = F.regexp_extract(c, r"^(>=|<=|>|<|=|\^|~)?", 1)
        want = parse(F.trim(F.regexp_replace(c, r"^(>=|<=|>|<|=|\^|~)", "")))
        caret = (version >= want) & F.when(want["major"] > 0, version["major"] == want["major"]).when(
            want["minor"] > 0, version["minor"] == want["minor"]
        ).otherwise(version["patch"] == want["patch"])
        tilde = (version >= want) & (version["major"] == want["major"]) & (version["minor"] == want["minor"])
        held = (
            F.when(op == ">=", version >= want)
            .when(op == "<=", version <= want)
            .when(op == ">", version > want)
            .when(op == "<", version < want)
            .when(op == "^", caret)
            .when(op == "~", tilde)
            .otherwise(version == want)
        )
        return F.coalesce(held, F.lit(False))

    any_ = F.trim(constraint).isin("", "*", "latest")
    parts = F.filter(F.transform(F.split(constraint, ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(any_, True).otherwise(F.forall(parts, clause))
