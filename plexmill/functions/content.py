"""Column expressions over file contents and paths: encodings, lines, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_segment_in, base_name, extension

#: File names and extensions and what they stand for.
MODULE_FILES = {
    "go.mod": "go", "package.json": "npm", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle",
    "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python", "composer.json": "composer",
}
BUILD_FILES = {
    "makefile": "make", "gnumakefile": "make", "taskfile.yml": "taskfile", "taskfile.yaml": "taskfile", "cmakelists.txt": "cmake",
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.json": "npm", "pnpm-lock.yaml": "pnpm",
    "yarn.lock": "yarn", "cargo.toml": "cargo",
}
CONFIG_EXTENSIONS = {
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".properties": "properties", ".xml": "xml",
}
DOC_NAMES = {
    "README": "readme", "CONTRIBUTING": "contributing", "SECURITY": "security", "LICENSE": "license", "COPYING": "license",
    "UNLICENSE": "license", "CHANGELOG": "changelog", "HISTORY": "changelog", "CHANGES": "changelog", "ROADMAP": "roadmap",
}
DOC_EXTENSIONS = [".md", ".txt", ".rst", ".adoc", ".html", ".pdf"]
VENDOR_DIRS = {"vendor": "go/php", "node_modules": "npm", "bower_components": "npm", ".venv": "python", "venv": "python"}
FILE_DOC_EXTENSIONS = [".md", ".txt", ".rst", ".adoc"]
FILE_CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".conf"]
#: White space around a line.
BLANKS = "\t\n\x0b\f\r \x85\xa0"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def encoding(content: Column) -> Column:
    """UTF-16 by mark, Unknown with a NUL in 8 KiB, ASCII or UTF-8 if valid, else Invalid."""
    head = F.hex(F.substring(content, 1, 8192))
    return (
        F.when(head.rlike("^(FFFE|FEFF)"), "UTF-16")
        .when(head.rlike("^(..)*00"), "Unknown")
        .when(F.is_valid_utf8(content.cast("string")) & head.rlike("^([0-7].)*$"), "ASCII")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .otherwise("Invalid")
    )


def line_ending(text: Column) -> Column:
    crlf, cr, lf = text.contains("\r\n"), text.rlike("\r(?!\n)"), text.rlike("(?<!\r)\n")
    kinds = crlf.cast("int") + cr.cast("int") + lf.cast("int")
    return F.when(kinds > 1, "Mixed").when(crlf, "CRLF").when(lf, "LF").when(cr, "CR").otherwise("Unknown")


def lines(text: Column) -> Column:
    """Lines without the empty one after a final newline."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def line_counts(text: Column, blanks: str = BLANKS) -> Column:
    """struct(total, blank, comment, in_block): // and # lines and /* */ blocks are comments; a blank line is blank in a block too.

    `blanks` are the characters that a blank line may hold, and that may stand before a mark of a comment.
    """

    def step(a: Column, line: Column) -> Column:
        t = F.btrim(line, F.lit(blanks))
        opens = t.startswith("/*")
        inside = a["in_block"]
        comment = inside | opens | t.startswith("//") | t.startswith("#")
        after = F.when(inside, ~t.contains("*/")).otherwise(opens & ~t.contains("*/"))
        blank = t == ""
        return F.struct(
            (a["total"] + 1).alias("total"),
            (a["blank"] + blank.cast("int")).alias("blank"),
            (a["comment"] + (comment & ~blank).cast("int")).alias("comment"),
            after.alias("in_block"),
        )

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(False).alias("in_block"))
    return F.aggregate(lines(text), zero, step)


def is_generated(text: Column) -> Column:
    """A generation mark, in its own case, in the first 50 lines."""
    both = lambda x: x.contains("Code generated") & x.contains("DO NOT EDIT")
    return F.exists(F.slice(lines(text), 1, 50), lambda x: both(x) | x.contains("@generated") | x.contains("AUTOGENERATED BY"))


def _from_dim(column: Column, dim: dict[str, str]) -> Column:
    out = None
    for k, v in dim.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def module_kind(path: Column) -> Column:
    return _from_dim(base_name(path), MODULE_FILES)


def build_system(path: Column) -> Column:
    return _from_dim(F.lower(base_name(path)), BUILD_FILES)


def config_kind(path: Column) -> Column:
    """By extension, else env for names that begin or end with .env, and for env itself."""
    name = base_name(path)
    env = name.startswith(".env") | (name == "env") | name.endswith(".env")
    return F.coalesce(_from_dim(extension(path), CONFIG_EXTENSIONS), F.when(env, "env"))


def doc_kind(path: Column) -> Column:
    """Decision records by folder or name, then whole names without their extension, then documents in a folder of documents."""
    name = base_name(path)
    stem = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    adr = path.contains("/adr/") | path.startswith("adr/") | stem.startswith("ADR")
    folder = path.rlike("^(docs|doc|documentation)/|/docs?/")
    out = F.when(adr, "adr")
    for k, v in DOC_NAMES.items():
        out = out.when(stem == k, v)
    return out.when(folder & extension(path).isin(DOC_EXTENSIONS), "general")


def is_vendored(path: Column) -> Column:
    return any_segment_in(F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), list(VENDOR_DIRS))


def vendor_root(path: Column) -> Column:
    """The path up to its first vendor folder, "" without one."""
    parts = F.split(path, "/")
    hit = F.transform(parts, lambda s: F.lower(s).isin(*VENDOR_DIRS))
    at = F.array_position(hit, F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at), "/")).otherwise("")


def vendor_ecosystem(vendor_path: Column) -> Column:
    """By the last segment of a vendor folder's path."""
    return F.coalesce(_from_dim(F.lower(base_name(vendor_path)), VENDOR_DIRS), F.lit("general"))


def file_kind(path: Column, language: Column, is_test: Column, enc: Column) -> Column:
    """test, binary, documentation, configuration, source or unknown: the first that fits."""
    return (
        F.when(is_test, "test")
        .when(enc == "Unknown", "binary")
        .when(extension(path).isin(FILE_DOC_EXTENSIONS) | F.lower(base_name(path)).startswith("readme"), "documentation")
        .when(extension(path).isin(FILE_CONFIG_EXTENSIONS), "configuration")
        .when(F.coalesce(language, F.lit("")) != "", "source")
        .otherwise("unknown")
    )
