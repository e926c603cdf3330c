"""URL filters against plain versions: parts of urls, longest rules, and hierarchical rates."""

import math
import random
import re

import pytest

from plexmill.llm import urls

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, n long, k long, bad boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "p", "r", "v", 1, 2, True) for i, u in rows], SCHEMA)


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_parts(host, suffixes):
    name = re.sub(r"\.$", "", re.sub(r"^.*@|:[0-9]*$", "", host))
    labels = name.split(".")
    if re.fullmatch(r"[0-9.]*", name) or name.startswith("[") or len(labels) < 2:
        return name, name
    n = 2 if len(labels) > 2 and ".".join(labels[-2:]) in suffixes else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def plain(rows, cfg=urls.UrlConfig(), outcomes=None):
    made = []
    for i, u in rows:
        host, path = plain_split(u)
        made.append((i, host, path, *plain_rule(host, path, cfg.rules)))
    known = [(h, v == "block") for _, h, _, _, v in made if v] if outcomes is None else outcomes
    hosts = {h: [0, 0] for _, h, _, _, _ in made} | {h: [0, 0] for h, _ in known}
    for h, bad in known:
        if bad is not None:
            hosts[h][0] += 1
            hosts[h][1] += bad
    of = {h: plain_parts(h, cfg.suffixes) for h in hosts}

    def added(name):
        out = {}
        for h, (n, k) in hosts.items():
            x = out.setdefault(name(h), [0, 0])
            x[0] += n
            x[1] += k
        return out

    def strength(groups, parent):
        m = {g: parent(g) for g in groups}
        pairs = sum(n * (n - 1) * m[g] * (1 - m[g]) for g, (n, k) in groups.items())
        excess = sum((k - n * m[g]) ** 2 - n * m[g] * (1 - m[g]) for g, (n, k) in groups.items())
        rho = excess / pairs if pairs else 0.0
        return 1 / min(0.999, max(0.001, rho)) - 1

    n, k = (sum(x[j] for x in hosts.values()) for j in (0, 1))
    top = (k + 0.5) / (n + 1.0)

    def shrunk(groups, parent):
        s = strength(groups, parent)
        return s, {g: (k + s * parent(g)) / (n + s) for g, (n, k) in groups.items()}

    _, suffix = shrunk(added(lambda h: of[h][1]), lambda g: top)
    _, domain = shrunk(added(lambda h: of[h]), lambda g: suffix[g[1]])
    s, host = shrunk(hosts, lambda h: domain[of[h]])
    out = []
    for i, h, p, rule, verdict in made:
        r, (n, k) = host[h], hosts[h]
        low = r - 1.645 * math.sqrt(r * (1 - r) / (n + s + 1))
        out.append((i, h, p, rule, verdict or ("block" if low > 0.5 else "allow"), n, k))
    return out


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


ODD = [
    None, "", "no scheme", "://", "http://", "http://x.org", "http://x.org/", "HTTP://Sub.EXAMPLE.org/es/1?x=://y", "http://example.org/en/1", "http://example.org/en/2",
    "https://a.b.example.org/en/19#f", "http://notexample.org/es/", "http://com/de/", "http://x.com?y=/de/", "http://x.com#/de/", "http://ÀÉ.com/fr/é", "http://u@h.co.uk:80/a",
    "http://10.0.0.1/a", "http://[::1]/a", "http://localhost/x", "http://x.org./", "ftp://a.com/de", "a://b://c.org/d", "http://x.org\n/a", "http://.com/fr/", "http://a.1.2/x", "http://1.2/x",
]


def pages(seed=0, n=600):
    r = random.Random(seed)
    rows = [(k, u) for k, u in enumerate(ODD)]
    hosts = [f"{s}.example{d}.{t}" for s in ("a", "b", "www") for d in ("", "2") for t in ("com", "net", "org", "co.uk")]
    bad = {h: r.random() for h in hosts}
    for k in range(n):
        h = r.choice([hosts[0], r.choice(hosts)])
        rows.append((100 + k, f"http://{h}/{'de' if r.random() < bad[h] else r.choice(['fr', 'en', 'es'])}/{k}"))
    return rows + [rows[5], (None, "http://x.com/de/1"), (None, None)]


@pytest.mark.parametrize("rows", [pages(), pages(1, 40), [(1, u) for u in ODD[:5]], [(2, "http://q.net/1")]])
def test_verdicts_equal_a_plain_version(spark, rows):
    got = [tuple(g) for g in urls.judge_urls(table(spark, rows)).drop("rate", "low").collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_reputations_from_given_outcomes(spark):
    """Hosts known to be bad are blocked, unknown ones of a bad domain too, few pages don't suffice."""
    known = [("evil.farm.net", True)] * 40 + [("more.farm.net", True)] * 30 + [("good.fine.net", False)] * 60 + [("once.fine.net", True), ("new.net", None)]
    rows = [(1, "http://evil.farm.net/a"), (2, "http://unseen.farm.net/a"), (3, "http://good.fine.net/"), (4, "http://once.fine.net/"), (5, "http://new.net/"), (6, "http://evil.farm.org/x")]
    outcomes = spark.createDataFrame(known, "host string, bad boolean")
    got = urls.judge_urls(table(spark, rows), outcomes).drop("rate", "low").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, outcomes=known))
    verdict = {g.page_id: g.verdict for g in got}
    assert [verdict[k] for k in (1, 3, 4, 5, 6)] == ["block", "allow", "allow", "allow", "allow"]


def test_rates_are_pulled_to_the_parent(spark):
    known = [(f"h{k}.one.net", k % 3 == 0) for k in range(30) for _ in range(10)] + [("few.one.net", True)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(known, "host string, bad boolean")).collect()}
    assert 0.9 < got["h0.one.net"].rate < 1 and 0 < got["h1.one.net"].rate < 0.1
    assert got["few.one.net"].rate < got["h0.one.net"].rate and got["few.one.net"].low < got["h0.one.net"].low


def test_no_rows_and_many_rules(spark):
    assert urls.judge_urls(table(spark, [])).collect() == []
    many = urls.UrlConfig(rules=tuple(("block", f"h{k}.net", "/") for k in range(501)))
    with pytest.raises(ValueError):
        urls.judge_urls(table(spark, [(1, "http://h3.net/")]), cfg=many)


def test_no_python_runs(spark):
    plan = urls.judge_urls(table(spark, pages()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
