import itertools

import numpy as np
import pytest

from plexmill.llm import components, embeddings, minhash
from plexmill.llm.storage import Workspace

from .helpers import documents, lowered, roots, shingle_set, texts


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    root = roots(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[k][0])
    return [(rows[k][0], len(sets[k]), None if rows[k][0] is None else least[root[k]]) for k in range(len(rows))]


@pytest.mark.parametrize(("size", "percent", "bands", "rows_"), [(3, 85, 24, 6), (5, 80, 32, 5)])
def test_minhash_agrees_with_all_pairs(spark, size, percent, bands, rows_):
    rows = texts()
    r = np.random.default_rng(3)
    base = rows[0][1].split()
    for k in range(60):  # a group of near copies that chain
        w = list(base)
        for i in r.integers(0, len(w), 1 + k % 9):
            w[i] = f"e{i}"
        rows.append((300 + k, " ".join(w)))
    got = minhash.near_duplicates(documents(spark, rows), minhash.MinHashConfig(size, percent, bands, rows_, block=16)).collect()
    want = brute(rows, size, percent)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=key) == sorted(want, key=key)
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = documents(spark)
    got = minhash.keep_one_of_each_group(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.select("doc_id").collect() if r.doc_id is not None)
    # Two texts of id 20 are no near copies, so both stay; the repeated one stays once.
    assert len(ids) == len(set(ids)) + 1 and ids.count(20) == 2
    assert 1 in ids and 2 not in ids and 10 in ids and 11 not in ids and 20 in ids and {7, 8, 9} <= set(ids)
    assert got.where("doc_id is null").count() == 2


def test_clean_rows_stay_and_copies_go_whatever_their_ids(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (5, "One two three four FIVE six"), (7, "x"), (7, "x"), (None, "x"), (8, "")]
    docs = documents(spark, rows).withColumnRenamed("node", "_kept").withColumnRenamed("bucket", "h1").withColumnRenamed("shard", "group")
    got = minhash.keep_one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [
        (0, "x"), (1, "one two three four five six"), (5, "alpha beta gamma delta epsilon zeta"), (7, "x"), (8, ""),
    ]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_of_like_build_are_told_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([x] * 5)), (2, " ".join([y] * 5)), (3, x), (4, y)]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {k: (k, True) for k in (1, 2, 3, 4)}


def test_shingles_lower_ascii_only(spark):
    rows = [(1, "ÀB CD EF GH"), (2, "àb cd ef gh")]
    assert lowered("ÀB") == "Àb"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, Workspace(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}


def vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16))
    rows = []
    for k in range(240):
        v = centres[k % 6] + r.normal(size=16) * 0.12 * (1 + k % 4)
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, rows[0][1], None), (1004, None, 0), (1005, [], 0)]
    rows += [(1006, [0.0] * 16, 0), (1007, [None] + [1.0] * 15, 0), (1008, [float("nan")] + [1.0] * 15, 0), (1009, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    rows += [(1010, [2 * x for x in rows[5][1]], 2), (1000, rows[3][1], 0)]
    return rows


@pytest.mark.parametrize("cells", [10_000, 20])
def test_embeddings_agree_with_all_pairs(spark, cells):
    rows = vectors()
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, count = [], [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93 - 1e-12:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    root = roots(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[k][0])
    want = [(rows[k][0], count[k], least.get(root[k])) for k in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("vec_id", "vec_id")
    got = embeddings.near_duplicates(df, embeddings.CosineConfig(cell_rows=cells, block=32)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert len(links) > 100
    assert sorted(((g.vec_id, g.n_links, g.component_id) for g in got), key=key) == sorted(want, key=key)


def test_embeddings_beside_columns_of_the_same_names(spark):
    """Columns named like those inside don't matter; rows that tie for the smallest id are all kept."""
    names = ["node", "cell", "copies", "kept", "visit", "n_links", "component_id", "vector", "dim", "links"]
    rows = vectors()
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clashing = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{n} string" for n in names))
    cfg = embeddings.CosineConfig(cell_rows=40, block=32)
    got, want = (sorted(map(repr, embeddings.near_duplicates(df, cfg).collect())) for df in (clashing, plain))
    assert got == want
    ties = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in embeddings.near_duplicates(ties).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_embeddings_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []


def test_links_across_cells_are_found(spark):
    """Recall on random vectors, each with a partner just over the threshold, against brute force."""
    r = np.random.default_rng(8)
    n, d = 3000, 64
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=(n, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = r.uniform(0.9301, 0.96, n)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    rows = [(k, [float(v) for v in (x if k % 2 == 0 else y)[k // 2]], 1) for k in range(2 * n)]
    cfg = embeddings.CosineConfig(cell_rows=100)
    got = {g.vec_id: g for g in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cfg).collect()}
    found = sum(got[k].n_links > 0 and got[k + 1].component_id <= k for k in range(0, 2 * n, 2))
    assert found / n >= 0.98
    # Far fewer visits than cells: 60 cells, 30 lower ones on average.
    every = _unit_rows(rows)
    c = embeddings.spherical_kmeans(every, 60, 10, 9)
    sim = every @ c.T
    home = sim.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
    visits = ((sim.max(axis=1)[:, None] - sim <= embeddings.margin(cfg, d) * gap) & (np.arange(60)[None, :] < home[:, None])).sum(axis=1)
    assert visits.mean() < 6


def _unit_rows(rows):
    x = np.array([v for _, v, _ in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_thousand_cells_fit_memory():
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from plexmill.llm import embeddings as E
r = np.random.default_rng(1)
c = r.normal(size=(1024, 64)); c /= np.linalg.norm(c, axis=1, keepdims=True)
x = r.normal(size=(10_000, 64))
batch = pa.record_batch({"label": pa.array(np.ones(10_000, np.int64)), "node": pa.array(np.arange(10_000)), "copies": pa.array(np.ones(10_000, np.int64)),
    "vector": pa.array([v.tobytes() for v in x], pa.binary())})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in E._cells({512: c}, E.CosineConfig())(iter([batch])))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, n)
"""
    used, n = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert used < 150 and 10_000 < n < 400_000


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_sets_are_made_where_texts_are_read(spark, monkeypatch, most):
    """No texts are dealt out, and ids that share a bit of the filter bring no other sets."""
    monkeypatch.setattr(minhash, "_MOST_BITS", most)
    cfg = minhash.MinHashConfig(3, 85, 24, 6)
    docs = documents(spark, texts()).select("doc_id", "text")
    wanted = minhash.signatures(docs, cfg).where("doc_id in (1, 4, 13, 20) and n_shingles > 0").select("doc_id", "node", "check")
    many = spark.range(1000, 41000).selectExpr("id doc_id", "id node", "id check")
    monkeypatch.setattr(minhash, "_id_filter", lambda ids, made=minhash._id_filter: made(ids.unionByName(many.select("doc_id"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = minhash._full_sets(docs, wanted, cfg)
        under = sets._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[1].split("Scan", 1)[0]
        assert "Exchange" not in under
        assert sorted(r.node for r in sets.collect()) == sorted({r.node for r in wanted.collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
