"""SQL of the queries that SQL can say, for DuckDB."""

from __future__ import annotations


def periodic_runs() -> str:
    r"""Pairs of equal words of one document by distance; islands of consecutive pairs are runs.

    CRC-32 is worked out by its table of 256 remainders, which SQL makes.
    """
    return r"""
WITH remainders AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM range(256) AS r(b)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), checked AS (
    SELECT r, doc_id, w, len(w)::BIGINT AS n,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, x: xor(c >> 8, remainders.t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM docs, remainders
), planned AS (
    SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a,
        CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p
    FROM checked
), plain AS MATERIALIZED (
    SELECT r, n, planted, a, p, unnest(w) AS word, unnest(range(n)) AS i FROM planned
), words AS MATERIALIZED (
    SELECT r, n, i, word FROM plain WHERE NOT coalesce(planted, false) OR i < a
    UNION ALL
    SELECT x.r, x.n, x.i, y.word FROM plain x JOIN plain y ON x.r = y.r AND y.i = x.a + (x.i - x.a) % x.p WHERE x.planted AND x.i >= x.a
), pairs AS (
    SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n
), islands AS (
    SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM pairs
), stretches AS (
    SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island
), runs AS MATERIALIZED (
    SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), best AS (
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
), listed AS (
    SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY r
), gone AS (
    SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
    ((1000 * length) // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN collapsed USING (r)
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A relation of book components for each round; the nearest entry is the least (distance, entry)."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""nearest{k} AS MATERIALIZED (
    SELECT r, p, min(d * {entries} + e) AS best FROM (
        SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM components JOIN book{k} USING (p, pos) GROUP BY r, p, e
    ) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
    SELECT p, e, pos, coalesce(moved, c) AS c FROM book{k} LEFT JOIN (
        SELECT p, (best % {entries})::BIGINT AS e, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS moved
        FROM components JOIN nearest{k} USING (r, p) GROUP BY ALL
    ) USING (p, e, pos)
)""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
    SELECT r, len(embedding) // {parts} AS width, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM kept
), components AS MATERIALIZED (
    SELECT r, place // width AS p, place % width AS pos, floor(x::DOUBLE * {scale})::BIGINT AS x FROM flat
), book0 AS MATERIALIZED (
    SELECT p, r - 1 AS e, pos, x AS c FROM components WHERE r <= {entries}
), {", ".join(steps)}, coded AS (
    SELECT r, string_agg(format('{{:02x}}', (best % {entries})::BIGINT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
    FROM nearest{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def url_filters() -> str:
    """The five rules by length; counts of pages a rule decides by host, domain and suffix; a moment estimate a level."""
    from .urls import SUFFIXES

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    two = ", ".join(f"'{s}'" for s in SUFFIXES)

    def strength(level: str) -> str:
        return (
            f"SELECT 1 / least(0.999, greatest(0.001, CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN "
            f"sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 0 END)) - 1 AS s FROM {level}"
        )

    return rf"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS MATERIALIZED (
    SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM split
), named AS (
    SELECT host, rule, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS name FROM ruled
), labelled AS (
    SELECT host, name, string_split(name, '.') AS l, count(rule) AS n, count(*) FILTER (WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')) AS k
    FROM named GROUP BY host, name
), kinds AS (
    SELECT *, regexp_matches(name, '^[0-9.]*$|^\[') OR len(l) < 2 AS whole, len(l) > 2 AND array_to_string(l[-2:], '.') IN ({two}) AS two FROM labelled
), hosts AS MATERIALIZED (
    SELECT host, n, k, CASE WHEN whole THEN name WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
        CASE WHEN whole THEN name WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM kinds
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM hosts)::DOUBLE AS m FROM hosts GROUP BY suffix
), s1 AS ({strength("suffixes")}), domains AS (
    SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value((u.k + s * u.m) / (u.n + s)) AS m FROM hosts h JOIN suffixes u USING (suffix), s1 GROUP BY h.domain, h.suffix
), s2 AS ({strength("domains")}), shrunk AS (
    SELECT h.host, h.n, h.k, (d.k + s * d.m) / (d.n + s) AS m FROM hosts h JOIN domains d USING (domain, suffix), s2
), s3 AS ({strength("shrunk")}), rated AS (
    SELECT host, n, k, s, (k + s * m) / (n + s) AS rate FROM shrunk, s3
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS n_labelled, k::BIGINT AS n_bad
FROM ruled JOIN rated USING (host)
"""
