"""Runs against brute force over every stretch and period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from plexmill.llm import periodic

from .helpers import documents, prose, texts, words


def plain_runs(w: list[str], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period at every place."""
    best = {}
    n = len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(least, times * q):
                    best.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in best.items())


def plain_planted(doc_id, w: list[str]) -> list[str]:
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text) -> tuple:
    w = plain_planted(doc_id, words(text))
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def awkward() -> list[tuple]:
    r = random.Random(4)
    rows = texts()
    for k in range(150):
        size = r.choice([1, 2, 2, 3])
        rows.append((1000 + k, " ".join(r.choice("abc"[:size]) for _ in range(r.randint(0, 90)))))
    rows += [(2000 + k, prose(k, r.randint(1, 300))) for k in range(60)]
    unit = prose(7, 23)
    rows += [(3000, " ".join([unit] * 9)), (3001, "x " * 700), (3002, "  a\x1ca \x85 " * 9), (3003, "a b a b a b a b c a b a b a b a b"), (3004, "a\x00 " * 7)]
    rows += [(-10, "q r " * 30), (None, "q r " * 30), (3000, " ".join([unit] * 9))]
    return rows


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_digest_equals_brute_force(spark):
    rows = awkward()
    docs = documents(spark, rows)
    from pyspark.sql import functions as F

    made = docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    got = [tuple(g) for g in periodic.digest(periodic.periodic_runs(made)).collect()]
    assert sorted(got, key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)
    assert sum(g[1] > 1 for g in got) > 10
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and words(t)) > 10


def test_documents_do_not_depend_on_those_read_beside(spark):
    rows = awkward()
    cfg = periodic.RunConfig(words_at_once=1, points_at_once=1)
    one = periodic.periodic_runs(documents(spark, rows), cfg).collect()
    all_ = periodic.periodic_runs(documents(spark, rows).coalesce(1)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, all_))
    assert periodic.periodic_runs(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_extensions_are_exact(seed):
    r = np.random.default_rng(seed)
    s = r.integers(0, 2, 300)
    if seed % 2:
        s[40:250] = np.tile(s[40:47], 30)
    at = r.integers(0, 301, (2000, 2))
    at = at[at[:, 0] != at[:, 1]]
    got = periodic.Extensions(s)(at[:, 0], at[:, 1])
    for (x, y), g in zip(at.tolist(), got.tolist(), strict=True):
        n = 0
        while x + n < 300 and y + n < 300 and s[x + n] == s[y + n]:
            n += 1
        assert g == n
    assert periodic.Extensions(s[:1])(np.array([0]), np.array([1])).tolist() == [0]


def test_long_periodic_texts_take_little_time():
    """Half a million words of one period, and as many of one word."""
    for period in (1, 977):
        s = np.arange(500_000) % period
        runs = periodic.find_runs(s, np.array([0, len(s)]))
        assert runs.tolist() == [[0, len(s), period]]


def test_ties_of_the_strongest_run():
    assert periodic.strongest(np.array([[0, 8, 2], [9, 12, 3], [30, 4, 1]])) == 0
    assert periodic.strongest(np.array([[0, 8, 2], [0, 13, 3], [30, 4, 1]])) == 1
