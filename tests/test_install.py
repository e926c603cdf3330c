"""Installation plans against a plain walk of the queue."""

import random

from plexmill.operators import install

CATALOG = "id string, version string, discoverable boolean"
DEPS = "id string, dependency string, constraint string, optional boolean, ordinal int"
TARGETS = "target string, version string"


def made(spark, targets, catalog, deps):
    frames = [spark.createDataFrame(rows, schema).coalesce(1) for rows, schema in ((targets, TARGETS), (catalog, CATALOG), (deps, DEPS))]
    return {tuple(r) for r in install.plans(*frames).collect()}


def test_named_cases(spark):
    catalog = [(i, v, True) for i, v in [
        ("single", "1.0.0"), ("app", "1.0.0"), ("lib-b", "1.0.0"), ("lib-b", "1.2.0"), ("lib-c", "2.0.0"), ("lib-c", "2.1.0"), ("no", "1.0.0"), ("high", "1.0.0"), ("dep", "1.0.0"), ("dep", "2.0.0"),
        ("plugin-a", "1.0.0"), ("plugin-b", "1.0.0"), ("self", "1.0.0"), ("may", "1.0.0"), ("both", "1.0.0"), ("left", "1.0.0"), ("right", "1.0.0"),
    ]] + [("lib-b", "1.9.0", False), (None, "1.0.0", True)]
    deps = [
        ("app", "lib-b", ">= 1.0.0", False, 1), ("lib-b", "lib-c", "^2.0.0", False, 1), ("no", "nonexistent", ">= 1.0.0", False, 1), ("high", "dep", ">= 3.0.0", False, 1),
        ("plugin-a", "plugin-b", ">= 1.0.0", False, 1), ("plugin-b", "plugin-a", ">= 1.0.0", None, 1), ("self", "self", None, False, 1),
        ("may", "gone", "", True, 1), ("may", "dep", ">= 3.0.0", True, 2), ("both", "left", "", False, 1), ("both", "right", "", False, 2), ("left", "dep", "^1.0.0", False, 1), ("right", "dep", "^2.0.0", False, 1),
        (None, "dep", "", False, 1), ("app", None, "", False, 2),
    ]
    targets = [(t, "1.0.0") for t in ("single", "app", "no", "high", "plugin-a", "self", "may", "both", "unknown", None)] + [("dep", "9.0.0")]
    assert made(spark, targets, catalog, deps) == {
        ("single", "single", "1.0.0", 1, None), ("app", "lib-c", "2.1.0", 1, None), ("app", "lib-b", "1.2.0", 2, None), ("app", "app", "1.0.0", 3, None),
        ("no", "nonexistent", None, None, "missing"), ("high", "dep", None, None, "conflict"), ("plugin-a", None, None, None, "cycle"), ("self", None, None, None, "cycle"),
        ("may", "may", "1.0.0", 1, None), ("both", "dep", None, None, "conflict"), ("unknown", None, None, None, "not_found"), ("dep", None, None, None, "version_not_found"),
    }


def test_empty_tables(spark):
    assert made(spark, [], [], []) == set()
    assert made(spark, [("a", "1.0.0")], [], []) == {("a", None, None, None, "not_found")}


def plain(target, version, catalog, deps):
    """One plan, by a queue and a recursive walk."""
    number = lambda v: tuple(map(int, v.split(".")))
    fits = lambda c, v: c == "" or (number(v) >= number(c[2:]) if c[0] == ">" else number(v)[0] == number(c[1:])[0])
    ids = {i for i, _, _ in catalog}
    if (target, version) not in {(i, v) for i, v, _ in catalog}:
        return {(target, None, None, None, "version_not_found" if target in ids else "not_found")}
    got, queue, edges = {target: version}, [target], {}
    for at in queue:
        for _, d, c, optional, _ in sorted((x for x in deps if x[0] == at), key=lambda x: x[4]):
            if d in got:
                if not fits(c, got[d]):
                    return {(target, d, None, None, "conflict")}
            else:
                can = [v for i, v, ok in catalog if i == d and ok and fits(c, v)]
                if not can:
                    if optional:
                        continue
                    return {(target, d, None, None, "conflict" if d in ids else "missing")}
                got[d] = max(can, key=number)
                queue.append(d)
            edges.setdefault(at, set()).add(d)
    left, inside = [], []

    def walk(i):
        if i in inside:
            raise RecursionError
        if i not in left:
            inside.append(i)
            for d in sorted(edges.get(i, ())):
                walk(d)
            inside.pop()
            left.append(i)

    try:
        for i in sorted(got):
            walk(i)
    except RecursionError:
        return {(target, None, None, None, "cycle")}
    return {(target, i, got[i], k, None) for k, i in enumerate(left, 1)}


def test_plans_equal_a_plain_walk(spark):
    rnd = random.Random(5)
    catalog, deps, targets = [], [], []
    for world in range(12):  # apart from each other, so that all go in one run
        names = [f"w{world}-{k}" for k in range(9)]
        for name in names:
            for v in sorted({f"{rnd.randint(1, 2)}.{rnd.randint(0, 2)}.0" for _ in range(4)}):
                catalog.append((name, v, rnd.random() < 0.85))
        for k, name in enumerate(names):
            for o in range(rnd.randint(0, 3)):
                to = rnd.choice(names[k + 1 :] or ["none"]) if rnd.random() < 0.85 else rnd.choice([*names, "none"])
                deps.append((name, to, rnd.choice(["", "", ">=1.1.0", "^1.0.0", "^2.0.0"] if rnd.random() < 0.4 else [""]), rnd.random() < 0.5, o))
        targets += [(name, v) for name in names for v in [next(v for i, v, _ in catalog if i == name)]]
    want = set().union(*(plain(t, v, catalog, deps) for t, v in targets))
    assert {p for *_, p in want} >= {None, "missing", "conflict", "cycle"}
    assert made(spark, targets, catalog, deps) == want
