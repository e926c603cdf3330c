"""Scoped listings, point lookups, searches and pages over symbols, files and packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed values.
DEFAULT_RESULTS = 50
MOST_PAGE = 500
FUZZY_FLOOR = 0.3


def find(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the values given; None leaves a column open."""
    conditions = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filter_nodes(df: DataFrame, kinds: list[str] | None = None, name_part: str = "", where: Column | None = None) -> DataFrame:
    """Rows of some kinds whose name has a part, in any case, and for which a predicate over any column holds."""
    got = df
    if kinds:
        got = got.where(F.col("kind").isin(*kinds))
    if name_part:
        got = got.where(F.lower("name").contains(name_part.lower()))
    return got if where is None else got.where(where)


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """The row with the trimmed id; raises if there is none."""
    got = df.where(F.col("id") == id_.strip())
    if got.isEmpty():
        raise KeyError(id_)
    return got


def list_symbols(symbols: DataFrame, scope: str, target: str = "") -> DataFrame:
    """All symbols, or those of a package (exact path; if there is none, by name or suffix), file or module."""
    if scope == "repository":
        got = symbols
    elif scope == "package":
        exact = F.col("package_path") == target
        loose = (F.col("package_name") == target) | F.col("package_path").endswith("/" + target)
        none = symbols.where(exact).limit(1).agg((F.count("*") == 0).alias("_none"))
        got = symbols.join(F.broadcast(none)).where(exact | (F.col("_none") & loose)).drop("_none")
    elif scope == "file":
        got = symbols.where(F.col("file_path") == target)
    elif scope == "module":
        got = symbols.where(F.col("file_path").startswith(target))
    else:
        raise ValueError(scope)
    return got.orderBy("id")


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0, default: int = 50, most: int = MOST_PAGE) -> DataFrame:
    """A page of a totally ordered frame; limits are put in range."""
    limit = default if limit <= 0 else min(limit, most)
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def filter_files(files: DataFrame, pattern: str = "", tests: bool = False, language: str = "", package: str = "") -> DataFrame:
    got = files
    if pattern:
        got = got.where(X.base_name(F.col("path")).rlike(X.glob_to_regex(pattern)) | F.col("path").rlike(X.glob_to_regex(pattern)))
    if not tests:
        got = got.where(~F.col("is_test"))
    if language:
        got = got.where(X.extension(F.col("path")) == "." + language.lstrip("."))
    if package:
        got = got.where(X.dir_name(F.col("path")).contains(package))
    return got


def match_order(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols (id, name, file) with score, best matches first."""
    scored = symbols.withColumn("score", X.match_score(query, F.col("name"), F.col("file")))
    return scored.where("score > 0").orderBy(F.desc("score"), "id")


def search_domain(df: DataFrame, query: str, domain: str, limit: int = DEFAULT_RESULTS, min_score: float = 0.0, **how) -> DataFrame:
    """(domain, id, name, path, score) of the best matches of one domain."""
    score = X.match_score(query, F.col("name"), F.col("path"), **how)
    hits = df.select(F.lit(domain).alias("domain"), "id", "name", "path", score.alias("score"))
    hits = hits.where((F.col("score") > 0) & (F.col("score") >= min_score))
    return hits.orderBy(F.desc("score"), "id").limit(limit)


def search(domains: dict[str, DataFrame], query: str, limit: int = DEFAULT_RESULTS, min_score: float = 0.0, **how) -> DataFrame:
    """The best matches over all domains, each cut to `limit` first."""
    parts = [search_domain(df, query, name, limit, min_score, **how) for name, df in domains.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "domain", "id").limit(limit)


def fuzzy_search(domains: dict[str, DataFrame], query: str, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """Matches of 0.3 or more by edit distance.

    A target whose length differs too much from the query's can't reach 0.3, so its
    distance isn't computed.
    """
    q = len(query.encode())
    parts = []
    for name, df in domains.items():
        n = F.octet_length("name")
        able = F.lower("name").contains(query.lower()) | (F.abs(F.char_length("name") - len(query)) <= 0.7 * F.greatest(n, F.lit(q)))
        score = F.when(able, X.fuzzy_score(query, F.col("name"))).otherwise(0.0)
        parts.append(df.select(F.lit(name).alias("domain"), "id", "name", "path", score.alias("score")).where(F.col("score") >= FUZZY_FLOOR))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "domain", "id").limit(limit)


def search_entities(entities: DataFrame, query: str, type_: str = "") -> DataFrame:
    q = query.lower()
    got = entities.where(F.lower("name").contains(q) | F.lower("id").contains(q))
    return (got.where(F.col("type") == type_) if type_ else got).orderBy("id")


def search_documents(files: DataFrame, query: str, **how) -> DataFrame:
    docs = files.where(F.lower("path").rlike(r"\.(md|markdown|txt)$|readme"))
    return search_domain(docs, query, "documentation", **how)


def search_configuration(files: DataFrame, query: str, **how) -> DataFrame:
    """Configuration files; the snippet of a sensitive path is masked."""
    config = files.where(F.lower("path").rlike(r"\.(json|ya?ml|toml|ini|xml|env)$"))
    got = search_domain(config, query, "configuration", **how)
    return got.withColumn("snippet", F.when(F.col("path").rlike(X.SENSITIVE_KEY), "***MASKED_CONFIG***").otherwise(F.col("path")))
