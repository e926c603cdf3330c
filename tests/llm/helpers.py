"""Small documents with every awkward case, and plain versions to hold results against."""

import random
import re

WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "über", "don't", "x1", "42"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, kept string, bucket string, `row` string, shard string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) * (r.random() < 0.5) for _ in range(n))


def texts() -> list[tuple]:
    base = prose(1, 200)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (20, 90, 150)]
    long = prose(2, 30_000)
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, near[0]), (5, near[1]), (6, near[2]), (7, None), (8, ""), (9, "  \n\t "), (10, "one"),
        (11, "one"), (12, "two words"), (13, long), (14, "x" * 20_000), (15, "日本語 テキスト 🙂 é"), (16, "Line a\nLine a\nLine b\r\nLine a"),
        (17, "All Rights Reserved. Licensed under CC BY-NC 4.0."), (18, "all rights reserved all rights reserved"), (None, base), (None, "no id"),
        (20, "tie tie tie"), (20, "tie tie tie"), (20, "another text of the same id"), (21, "\x00\x01 control\x7f"), (22, "<|endoftext|> <s> </s>"),
    ]
    rows += [(100 + k, prose(50 + k, 60 + k)) for k in range(20)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "k", "b", "r", "s") for i, t in rows], SCHEMA)


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None, size: int) -> set:
    w = words(lowered(text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]
