"""Column expressions for search scores, tokens, paths, secrets and licences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose snippets a search masks, keys whose values a finding hides, and words after which a reason is cut.
SENSITIVE_KEY = r"(?i)(password|secret|token|apikey|api_key|private_key|auth|credential|cert|bearer|access_token|private)"
SECRET_KEY = r"(?i)(password|secret|token|api_key|apikey|auth|private_key)"
REASON_WORDS = ["password", "secret", "token", "apikey", "bearer", "private_key"]


def glob_to_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression: * and ? stay within a path segment."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def match_score(query: str, name: Column, path: Column, case_sensitive: bool = False, exact: bool = False) -> Column:
    """Lexical score 0 to 1.  A glob is tried before equality, so an exact name scores 0.95."""
    q = query if case_sensitive else query.lower()
    if q in ("", "*", "."):
        return F.lit(1.0)
    n, p = (name, path) if case_sensitive else (F.lower(name), F.lower(path))
    pattern = glob_to_regex(q)
    ratio = F.lit(float(len(q.encode()))) / F.octet_length(n)
    # Without a wildcard a pattern is an equality, which needs no regular expression.
    is_glob = any(c in q for c in "*?[\\")
    score = F.when(n.rlike(pattern) if is_glob else n == q, 0.95).when(p.rlike(pattern) if is_glob else p == q, 0.90)
    if exact:
        return score.when(n == q, 1.0).otherwise(0.0)
    return (
        score.when((n == q) | (p == q), 1.0)
        .when(n.startswith(q), 0.8 + 0.1 * ratio)
        .when(n.contains(q), 0.6 + 0.1 * ratio)
        .when(p.contains(q), 0.4)
        .otherwise(0.0)
    )


def fuzzy_score(query: str, target: Column, case_sensitive: bool = False) -> Column:
    """1 equal, 0.9 prefix, 0.75 inside, else 1 - edit distance / longer length in bytes, 0 at least."""
    q = query if case_sensitive else query.lower()
    t = target if case_sensitive else F.lower(target)
    longest = F.greatest(F.octet_length(t), F.lit(len(q.encode())))
    return (
        F.when(t == q, 1.0)
        .when(t.startswith(q), 0.9)
        .when(t.contains(q), 0.75)
        .when(longest == 0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(t, F.lit(q)) / longest))
    )


def tokens(text: Column) -> Column:
    """Lower-cased tokens of letters, numbers, - and _."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda t: t != "")


def _tag_score(tags: Column, word: str) -> Column:
    one = lambda t: F.when(F.lower(t) == word, 25.0).when(F.lower(t).contains(word), 12.0).otherwise(0.0)
    return F.aggregate(tags, F.lit(0.0), lambda a, t: a + one(t))


def relevance(words: list[str], id_: Column, name: Column, description: Column, tags: Column, publisher: Column) -> Column:
    """Field-weighted score of search words; a word that matches nowhere makes it 0."""
    if not words:
        return F.lit(1.0)
    i, n, d, p = F.lower(id_), F.lower(name), F.lower(description), F.lower(publisher)
    total, every = F.lit(0.0), F.lit(True)
    for w in (x.lower() for x in words):
        by_id = F.when(i == w, 100.0).when(i.contains(w), 40.0).otherwise(0.0)
        by_name = F.when(n == w, 80.0).when(n.contains(w), 30.0).otherwise(0.0)
        by_text = F.when(d.contains(w), 10.0).otherwise(0.0)
        by_tag = _tag_score(tags, w)
        by_publisher = F.when(p.contains(w), 15.0).otherwise(0.0)
        score = by_id + by_name + by_text + by_tag + by_publisher
        total, every = total + score, every & (score > 0)
    return F.when(every, total).otherwise(0.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """Directory of a path, "." at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def clean_path(path: Column) -> Column:
    """A path without empty, "." and resolvable ".." segments; "." if nothing is left."""

    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), kept)).when(kept == "", ".").otherwise(kept)


def first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def any_segment_in(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def redact(key: Column, value: Column) -> Column:
    return F.when(key.rlike(SECRET_KEY), F.lit("[REDACTED]")).otherwise(value)


def sanitize_reason(message: Column) -> Column:
    """Cut after the first listed word that occurs (in list order) and mark the cut."""
    out = None
    for word in REASON_WORDS:
        at = F.locate(word, F.lower(message))
        cut = F.concat(F.substring(message, F.lit(1), at + F.lit(len(word) - 1)), F.lit("=[REDACTED]"))
        out = F.when(at > 0, cut) if out is None else out.when(at > 0, cut)
    return out.otherwise(message)


#: Names of licence families, in the order they are tried.
FAMILIES = ["MIT", "APACHE", "BSD", "LGPL", "GPL", "MPL"]


def license_family(text: Column) -> Column:
    """The first family whose name occurs, in this order."""
    upper = F.upper(text)
    out = None
    for name in FAMILIES:
        out = F.when(upper.contains(name), name) if out is None else out.when(upper.contains(name), name)
    return out.otherwise("UNKNOWN")


def package_of_symbol(symbol_id: Column) -> Column:
    """The part before the last ".(", else before the last ".", else "."."""
    return (
        F.when(symbol_id.contains(".("), F.regexp_extract(symbol_id, r"(?s)^(.*)\.\(", 1))
        .when(symbol_id.contains("."), F.regexp_extract(symbol_id, r"(?s)^(.*)\.", 1))
        .otherwise(".")
    )


def is_exported(symbol_id: Column) -> Column:
    return F.substring_index(symbol_id, ".", -1).rlike("^[A-Z]")


def visibility(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")


def graph_id(prefix: str, id_: Column) -> Column:
    """An id for drawing languages; other characters become _ and may collide."""
    return F.concat(F.lit(prefix), F.regexp_replace(id_, "[^A-Za-z0-9]", "_"))


def canonical_cycle(cycle: Column) -> Column:
    """A cycle without its closing element, rotated so that its smallest element is first."""
    n = F.size(cycle)
    closed = (n > 1) & (F.get(cycle, F.lit(0)) == F.get(cycle, n - 1))
    core = F.when(closed, F.slice(cycle, F.lit(1), n - 1)).otherwise(cycle)
    at = F.array_position(core, F.array_min(core)).cast("int")
    turned = F.concat(F.slice(core, at, F.size(core)), F.slice(core, F.lit(1), at - 1))
    return F.array_join(F.concat(turned, F.slice(turned, 1, 1)), " -> ")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def owner_of_url(url: Column) -> Column:
    """Owner segment of an https or ssh remote."""
    return F.regexp_extract(url, r"^(?:[a-z]+://[^/]+/|[^@/]+@[^:]+:)([^/]+)/", 1)
