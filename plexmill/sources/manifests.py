"""Dependencies from manifests, imports and symbols from sources, all as expressions over (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SCHEMA = ["path", "name", "version", "ecosystem", "dep_type"]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line", "text"))


def _row(df: DataFrame, name: Column, version: Column, ecosystem: str, kind: Column) -> DataFrame:
    return df.select(
        "path", name.alias("name"), F.coalesce(version, F.lit("")).alias("version"), F.lit(ecosystem).alias("ecosystem"), kind.alias("dep_type")
    )


def _sections(files: DataFrame, head: str) -> DataFrame:
    """Lines with the section they stand in: the last header before them in their own file."""
    found = F.aggregate(
        F.transform(F.split(F.col("content").cast("string"), r"\r?\n"), lambda x: F.struct(x.alias("text"))),
        F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,text:string>>").alias("rows")),
        lambda a, x: F.struct(
            F.when(x["text"].rlike(head), F.regexp_extract(x["text"], head, 1)).otherwise(a["section"]).alias("section"),
            F.array_append(
                a["rows"],
                F.struct(F.when(x["text"].rlike(head), F.regexp_extract(x["text"], head, 1)).otherwise(a["section"]).alias("section"), x["text"].alias("text")),
            ).alias("rows"),
        ),
    )
    return files.select("path", F.explode(found["rows"]).alias("r")).select("path", "r.section", "r.text")


def go_mod(files: DataFrame) -> DataFrame:
    """require lines and blocks; // indirect marks indirect ones."""
    form = r"^\s*(?:require\s+)?([\w.~-]+\.[\w./~-]+)\s+(v\S+)"
    got = _lines(files).where(F.col("text").rlike(form) & ~F.col("text").rlike(r"^\s*(module|replace|exclude|go)\b"))
    kind = F.when(F.col("text").contains("// indirect"), "indirect").otherwise("runtime")
    return _row(got, F.regexp_extract("text", form, 1), F.regexp_extract("text", form, 2), "go", kind)


def _json_maps(files: DataFrame, ecosystem: str, sections: dict[str, str]) -> DataFrame:
    schema = ", ".join(f"`{s}` map<string,string>" for s in sections)
    parsed = files.select("path", F.from_json(F.col("content").cast("string"), schema).alias("m"))
    parts = [
        _row(parsed.select("path", F.explode(F.col("m")[s]).alias("name", "version")), F.col("name"), F.col("version"), ecosystem, F.lit(kind))
        for s, kind in sections.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def package_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "npm", {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "runtime"})


def composer_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "composer", {"require": "runtime", "require-dev": "dev"})


def cargo_toml(files: DataFrame) -> DataFrame:
    form = r"^\s*([\w-]+)\s*=\s*(?:\"([^\"]*)\"|\{.*?version\s*=\s*\"([^\"]*)\".*\})"
    got = _sections(files, r"^\s*\[([^\]]+)\]").where(F.col("section").rlike("dependencies$") & F.col("text").rlike(form))
    version = F.coalesce(F.nullif(F.regexp_extract("text", form, 2), F.lit("")), F.regexp_extract("text", form, 3))
    kind = F.when(F.col("section").startswith("dev-"), "dev").when(F.col("section").startswith("build-"), "build").otherwise("runtime")
    return _row(got, F.regexp_extract("text", form, 1), version, "cargo", kind)


def pom_xml(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.explode(F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("b"))
    tag = lambda t: F.trim(F.regexp_extract("b", f"(?s)<{t}>(.*?)</{t}>", 1))
    kind = F.when(tag("scope") == "test", "dev").otherwise("runtime")
    return _row(blocks, F.concat_ws(":", tag("groupId"), tag("artifactId")), tag("version"), "maven", kind)


def gradle(files: DataFrame) -> DataFrame:
    form = r"^\s*(\w*(?:[iI]mplementation|api|compileOnly|runtimeOnly))\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+)(?::([^'\"]+))?['\"]"
    got = _lines(files).where(F.col("text").rlike(form))
    kind = F.when(F.lower(F.regexp_extract("text", form, 1)).startswith("test"), "dev").otherwise("runtime")
    return _row(got, F.regexp_extract("text", form, 2), F.regexp_extract("text", form, 3), "gradle", kind)


def requirements_txt(files: DataFrame) -> DataFrame:
    form = r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:==|>=|<=|~=|!=|>|<)[^#;]*)?"
    got = _lines(files).where(F.col("text").rlike(r"^\s*[A-Za-z0-9]"))
    return _row(got, F.regexp_extract("text", form, 1), F.trim(F.regexp_extract("text", form, 2)), "pypi", F.lit("runtime"))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of the manifests among `files`, by file name."""
    name = X.base_name(F.col("path"))
    parsers = {
        "go.mod": go_mod, "package.json": package_json, "composer.json": composer_json, "Cargo.toml": cargo_toml, "pom.xml": pom_xml,
        "build.gradle": gradle, "build.gradle.kts": gradle, "requirements.txt": requirements_txt,
    }
    out = None
    for k, f in parsers.items():
        got = f(files.where(name == k))
        out = got if out is None else out.unionByName(got)
    return out


def imports(files: DataFrame) -> DataFrame:
    """(path, target): import targets of Go, JavaScript, TypeScript and Python sources."""
    text = F.col("content").cast("string")
    block = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?s)import\s*\((.*?)\)"), 1), lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"]+)\""), 1))
    )
    go = F.concat(block, F.regexp_extract_all(text, F.lit(r"(?m)^import\s+(?:\w+\s+)?\"([^\"]+)\""), 1))
    js = F.regexp_extract_all(text, F.lit(r"(?:from\s+|require\(\s*|import\s+)['\"]([^'\"]+)['\"]"), 1)
    py = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)"), 0)
    py = F.transform(py, lambda x: F.regexp_extract(x, r"(?:from|import)\s+([\w.]+)", 1))
    ext = X.extension(F.col("path"))
    found = F.when(ext == ".go", go).when(ext.isin(".js", ".ts", ".jsx", ".tsx"), js).when(ext == ".py", py)
    return files.select("path", F.explode(F.array_distinct(found)).alias("target"))


def go_symbols(files: DataFrame) -> DataFrame:
    """Top-level symbols of Go sources: id, kind, name, package_path, file_path, receiver, is_exported, signature, line.

    Declarations are found by line, as gofmt lays them out, with built-in functions alone; `golang.declarations`
    reads whole sources.
    """
    src = files.where(X.extension(F.col("path")) == ".go")
    func = r"^func\s+(?:\(\s*\w*\s*(\*?\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(\([^{]*)"
    typ = r"^type\s+(\w+)(?:\[[^\]]*\])?\s*(=)?\s*(struct|interface)?"
    val = r"^(const|var)\s+(\w+)"
    d = _lines(src).where(F.col("text").rlike("^(func|type|const|var)\\s+[\\w(]"))
    x = lambda form, i: F.regexp_extract("text", form, i)
    receiver = x(func, 1)
    is_func, is_type = F.col("text").rlike(func), F.col("text").rlike(typ)
    kind = (
        F.when(is_func & (receiver != ""), "method").when(is_func, "function").when(is_type & (x(typ, 2) != ""), "alias")
        .when(is_type & (x(typ, 3) != ""), x(typ, 3)).when(is_type, "type").otherwise(x(val, 1))
    )
    name = F.when(is_func, x(func, 2)).when(is_type, x(typ, 1)).otherwise(x(val, 2))
    package = X.dir_name(F.col("path"))
    rows = d.select(
        kind.alias("kind"), name.alias("name"), package.alias("package_path"), F.col("path").alias("file_path"),
        F.when(is_func, receiver).otherwise("").alias("receiver"),
        F.when(is_func, F.trim(x(func, 3))).otherwise("").alias("signature"), (F.col("line") + 1).alias("line"),
    ).where("name <> ''")
    member = F.when(F.col("receiver") != "", F.concat(F.lit("("), F.col("receiver"), F.lit(")."), F.col("name"))).otherwise(F.col("name"))
    full = F.when(F.col("package_path") == ".", member).otherwise(F.concat_ws(".", "package_path", member))
    return rows.select(full.alias("id"), "*", F.col("name").rlike("^[A-Z]").alias("is_exported"))
