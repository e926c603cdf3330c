"""URL filters: rules of host and path, and host reputations shrunk through beta-binomial priors.

Pages whose outcome is known give each host a number of labelled pages and of bad ones.  A
host's rate of bad pages is shrunk to its registered domain's, that to its suffix's, and that
to the rate of all.  How far is learnt from the data at each level: with n pages and a parent's
rate m, the squared distance of k from n m exceeds that of a binomial by a factor that grows
with the correlation of outcomes within a group, and the moments of all groups give it.  A page
that no rule decides is blocked if the lower bound of its host's posterior rate exceeds a limit.
All steps are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

#: Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Suffixes of two labels under which domains are registered.
SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.mx", "gov.uk", "org.uk"]


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[tuple[str, str, str], ...] = tuple(RULES)
    suffixes: tuple[str, ...] = tuple(SUFFIXES)
    most_rules: int = 500  # they become one expression; more are an error
    z: float = 1.645  # standard deviations between the posterior's mean and its bound
    limit: float = 0.5  # rate of bad pages that the lower bound must exceed to block
    least_correlation: float = 0.001
    most_correlation: float = 0.999


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`; both empty where the url is null or has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column, cfg: UrlConfig) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user, port and final dot; an address or a single label is both."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    whole = name.rlike(r"^[0-9.]*$|^\[") | (F.size(labels) < 2)
    two = last(2).isin(*cfg.suffixes) & (F.size(labels) > 2) if cfg.suffixes else F.lit(False)
    return F.when(whole, name).otherwise(F.when(two, last(3)).otherwise(last(2))), F.when(whole, name).otherwise(F.when(two, last(2)).otherwise(last(1)))


def rule_of(host: Column, path: Column, cfg: UrlConfig) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one.  Of rules of one length a blocking one wins, then by text."""
    if len(cfg.rules) > cfg.most_rules:
        raise ValueError(f"more than {cfg.most_rules} rules")
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(cfg.rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):  # the last stands first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, cfg: UrlConfig) -> float:
    """Weight of the parent's rate, in pages, from (n, k, parent) of all groups."""
    n, k, m = F.col("n"), F.col("k"), F.col("parent")
    row = groups.agg(
        F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)).alias("excess"), F.sum(n * (n - 1) * m * (1 - m)).alias("pairs")
    ).first()
    correlation = row.excess / row.pairs if row.pairs else 0.0
    correlation = min(cfg.most_correlation, max(cfg.least_correlation, correlation))
    return 1 / correlation - 1


def reputations(outcomes: DataFrame, cfg: UrlConfig = UrlConfig()) -> DataFrame:
    """host, n_labelled, n_bad, rate, low of every host of `outcomes` (host, bad; a null bad is no label).

    rate and low are the mean and the lower bound of the posterior rate of bad pages.
    """
    work = Workspace(outcomes.sparkSession, "urls")
    domain, suffix = domain_parts(F.col("host"), cfg)
    # A row for each host; pages are added up by the tasks that read them.
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("k"))
    hosts = work.save(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    shrunk = lambda s: (F.col("k") + s * F.col("parent")) / (F.col("n") + s)
    suffixes = suffixes.withColumn("parent", F.lit((k + 0.5) / (n + 1.0)))
    suffixes = suffixes.select("suffix", shrunk(_strength(suffixes, cfg)).alias("parent"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", shrunk(_strength(domains, cfg)).alias("parent"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    weight = _strength(hosts, cfg)
    rate = shrunk(weight)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))
    return hosts.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), rate.alias("rate"), (rate - cfg.z * spread).alias("low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame | None = None, cfg: UrlConfig = UrlConfig(), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, rate, low for each row of `pages`.

    The longest rule that fits decides; else the host's reputation: `block` where `low`
    exceeds the limit.  Reputations are learnt from `outcomes` (host, bad), or without it from
    the pages that a rule decides, a blocked page being a bad one.  Defined cases: a null url,
    or one without `://`, has an empty host and path and fits no rule; empty hosts share one
    reputation; hosts without labelled pages have their domain's, its suffix's or the rate of
    all; without any labelled page that is one half, which does not exceed the limit; a null
    page_id stays null; repeated rows are returned as often as they occur; an empty table
    gives an empty result; other columns are ignored.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), cfg)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    if outcomes is None:
        outcomes = rows.select("host", (F.col("ruled") == "block").alias("bad"))
    else:  # every host of the pages gets a reputation
        outcomes = outcomes.select(F.col("host").cast("string").alias("host"), F.col("bad").cast("boolean").alias("bad"))
        outcomes = outcomes.where("host is not null").unionByName(rows.select("host", F.lit(None).cast("boolean").alias("bad")))
    learnt = F.when(F.col("low") > cfg.limit, "block").otherwise("allow")
    return rows.join(reputations(outcomes, cfg), "host").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "n_labelled", "n_bad", "rate", "low"
    )
