"""Codes against plain integer k-means that evaluates every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from plexmill.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, dim int, error long, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, "v") for i, v, lab in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, sha256) of rows that can be coded."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda p, x: min((square(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(best(p, cut(v, p))[1], []).append(cut(v, p))
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        got = [best(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return [(i, c, e, total[lab], sha) for i, c, e, lab in out]


def rows(n=300, dim=16, seed=1):
    r = random.Random(seed)
    return [(k, [r.gauss(0, 1 + k % 5) for _ in range(dim)], r.choice([0, 0, 0, 1, None])) for k in range(n)]


ODD = [
    (1000, None, 0), (1001, [None] + [1.0] * 15, 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] + [0.0] * 15, 1), (1004, [], 0),
    (1005, [0.0] * 16, None), (1006, [0.5] * 24, 0), (1007, [0.5] * 15, 0), (None, [0.25] * 16, 2), (None, [-0.25] * 16, 2), (3, [0.125] * 16, 0), (3, [-0.1] * 16, 0),
]


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("data", [rows() + ODD, rows(9), [(k, [float(k % 2)] * 8, None) for k in range(40)], ODD[:5]])
def test_digest_equals_brute_force(spark, data):
    got = [tuple(g) for g in V.digest(V.compress(table(spark, data).repartition(5))).collect()]
    assert sorted(got, key=key) == sorted(plain(data), key=key)


def test_no_rows(spark):
    assert V.digest(V.compress(table(spark, []))).collect() == []


def test_components_whose_distances_exceed_a_long_go(spark):
    most = V.most_component(8)
    assert 4 * most * most * 8 <= 1 << 62
    big = [(1, [3e38] * 8, 0), (2, [9e4] * 8, 0), (3, [-7e4] * 8, 0)]
    got = [tuple(g) for g in V.digest(V.compress(table(spark, big))).collect()]
    assert sorted(got, key=key) == sorted(plain(big[1:]), key=key)


def test_an_annulus_is_exact_and_spares_distances():
    r = np.random.default_rng(5)
    entries = np.floor(r.normal(size=(64, 8)) * np.geomspace(1, 500, 64)[:, None] * 4096).astype(np.int64)
    entries[40] = entries[7]  # ties go to the lower entry
    near = entries[r.integers(0, 64, 2000)] + np.floor(r.normal(size=(2000, 8)) * 4096).astype(np.int64)
    x = np.concatenate([near, np.floor(r.normal(size=(300, 8)) * r.uniform(1, 600, 300)[:, None] * 4096).astype(np.int64), entries, -entries])
    book = V.Codebook(entries)
    entry, far = book.nearest(x)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (far == d.min(axis=1)).all()
    assert (entry == d.argmin(axis=1)).all()
    assert book.evaluated < 0.3 * d.size


def test_an_entry_on_the_rim_of_the_annulus_counts():
    """The nearest by norm and another entry at one distance, which is the difference of norms."""
    entries = np.array([[5, 0], [1, 0]], np.int64)
    entry, far = V.Codebook(entries).nearest(np.array([[3, 0]], np.int64))
    assert (entry.tolist(), far.tolist()) == ([0], [4])
    entry, _ = V.Codebook(entries[::-1].copy()).nearest(np.array([[3, 0]], np.int64))
    assert entry.tolist() == [0]
