"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (at most 3 to the number
of labellers, however many documents) estimates each labeller's accuracy and the
posterior of each pattern.  The posteriors are the training labels of a hashed
linear scorer, which then scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .quality import COMMON_WORDS, SYMBOLS
from .storage import Workspace


@dataclass(frozen=True)
class WeakLabelConfig:
    dims: int = 1024
    sample: int = 4096  # distinct texts that the scorer is trained on, the first by a hash
    most_weight: int = 8  # of a text that occurs more often than this in training
    em_rounds: int = 100
    train_rounds: int = 300
    rate: float = 4.0
    decay: float = 1e-4
    threshold: float = 0.5


LABELLERS = ("length", "word_length", "symbols", "repetition", "duplicate_lines", "common_words", "variety", "digits")


def _common_hashes() -> np.ndarray:
    words = sorted({w.encode() for text in COMMON_WORDS.values() for w in text.split()})
    ends = np.cumsum([len(w) for w in words])
    return np.sort(K.range_hash(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends))


def _share(hit: np.ndarray, owner: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(owner, hit, n) / np.maximum(of, 1)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner, told apart by 44 bits."""
    key = (owner.astype(np.uint64) << np.uint64(44)) | (K.mix64(h) >> np.uint64(20))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def _class_shares(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Share of each text's bytes that are of a class."""
    size = np.diff(offsets)
    out = np.zeros(len(size))
    has = size > 0
    if has.any():
        out[has] = np.add.reduceat(inside[raw], offsets[:-1][has], dtype=np.int64) / size[has]
    return out


_SYMBOL, _DIGIT, _LINE = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_DIGIT[48:58] = True
_LINE[10] = False


def votes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes (texts by labellers) of 1 good, -1 bad, 0 none."""
    n = len(offsets) - 1
    low = K.lowered(raw)
    w = K.words(low, offsets)
    count = w.counts()
    owner = np.repeat(np.arange(n), count)
    mean = np.bincount(owner, w.end - w.start, n) / np.maximum(count, 1)
    symbols = _class_shares(raw, offsets, _SYMBOL)
    digits = _class_shares(raw, offsets, _DIGIT)
    common = _common_hashes()
    at = np.minimum(np.searchsorted(common, w.hash), len(common) - 1)
    usual = _share(common[at] == w.hash, owner, n, count)
    # Windows of three words, those across texts left out.
    inner = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    window = w.hash[inner] * np.uint64(3) + w.hash[inner + 1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[inner + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    fresh = _distinct(owner[inner], window, n) / np.maximum(count - 2, 1)
    fresh[count < 3] = 1.0
    lines = K.words(raw, offsets, _LINE)
    own_lines = _distinct(np.repeat(np.arange(n), lines.counts()), lines.hash, n) / np.maximum(lines.counts(), 1)
    variety = _distinct(owner, w.hash, n) / np.maximum(count, 1)

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return good.astype(np.int8) - (bad & ~good).astype(np.int8)

    enough = count >= 20
    return np.stack(
        [
            vote(count >= 50, count < 1),
            vote((mean >= 3) & (mean <= 7), (mean < 2) | (mean > 9)),
            vote(symbols < 0.005, symbols > 0.02),
            vote(enough & (fresh > 0.9), enough & (fresh < 0.6)),
            vote((lines.counts() > 1) & (own_lines > 0.9), own_lines < 0.7),
            vote(usual > 0.08, enough & (usual < 0.02)),
            vote(enough & (variety > 0.3), enough & (variety < 0.15)),
            vote(enough & (digits < 0.05), digits > 0.2),
        ],
        axis=1,
    )


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, accuracies, share of good) by expectation-maximisation.

    Each labeller has an accuracy for good and one for bad documents (rows of the second
    result); a labeller that doesn't vote says nothing; votes are independent given the
    class.  The start takes a document with any bad vote for bad, and accuracies on good
    documents stay at 0.5 or more, which keeps the classes from changing places.
    """
    voted, up = patterns != 0, patterns > 0
    post = np.where((voted & ~up).any(axis=1), 0.2, 0.98)
    acc = np.full((2, patterns.shape[1]), 0.8)
    good = 0.9
    for _ in range(rounds):
        for row, weight, right in ((0, counts * post, up), (1, counts * (1 - post), voted & ~up)):
            hits = (weight[:, None] * (voted & right)).sum(axis=0) + 1
            acc[row] = hits / ((weight[:, None] * voted).sum(axis=0) + 2)
        acc[0] = np.clip(acc[0], 0.5, 0.999)
        acc[1] = np.clip(acc[1], 0.01, 0.99)
        good = float(np.clip((counts * post).sum() / max(counts.sum(), 1e-9), 0.01, 0.99))
        given_good = np.where(voted, np.where(up, np.log(acc[0]), np.log(1 - acc[0])), 0).sum(axis=1)
        given_bad = np.where(voted, np.where(up, np.log(1 - acc[1]), np.log(acc[1])), 0).sum(axis=1)
        lean = np.log(1 - good) + given_bad - np.log(good) - given_good
        post = 1 / (1 + np.exp(np.clip(lean, -500, 500)))
    return post, acc, good


def hashed(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Unit rows of square roots of hashed counts of three-byte stretches."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    if len(raw) < 3:
        return out
    b = K.lowered(raw).astype(np.uint32)
    slots = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(12)
    slots = (slots % np.uint32(dims)).astype(np.int64)
    for i in range(n):
        lo, hi = offsets[i], offsets[i + 1] - 2  # stretches don't reach into the next text
        if hi > lo:
            row = np.sqrt(np.bincount(slots[lo:hi], minlength=dims))
            out[i] = row / np.sqrt((row * row).sum())
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cfg: WeakLabelConfig) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft labels of weighted rows, by accelerated full-batch descent."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = weight / weight.sum()
    w = np.zeros(x.shape[1])
    ahead = w.copy()
    for k in range(cfg.train_rounds):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        grad = x.T @ ((p - y) * share) + cfg.decay * ahead
        new = ahead - cfg.rate * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def classify(docs: DataFrame, cfg: WeakLabelConfig = WeakLabelConfig()) -> DataFrame:
    """doc_id, votes (text such as ++0-), weak_label, score, kept for each row of `docs`.

    score is the linear scorer's; weak_label is the posterior of the document's votes.
    kept: the mean of the two reaches the threshold.  Vote patterns are counted over all
    documents; the scorer learns from a bounded sample.  Defined cases: a null or empty
    text has its votes as an empty one and the scorer's bias as score; a null doc_id stays
    null; repeated rows are returned as often as they occur; an empty table gives an empty
    result; other columns are ignored; a long text is held whole, with some 30 bytes for each
    of its words, by the task that reads it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def vote_rows(it):
        for batch in it:
            for lo, hi, raw, offs in K.row_ranges(batch.column("text")):
                v = votes(raw, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h").slice(lo, hi - lo), pa.array([k.tobytes() for k in v], pa.binary())], ["h", "pattern"]
                )

    # Texts are read once for this, once for the sample and once to be scored.
    text_hash = F.xxhash64("text").alias("h")
    voted = Workspace(docs.sparkSession, "weaklabel").save(
        rows.select(text_hash, "text").mapInArrow(vote_rows, "h long, pattern binary"), "votes"
    )
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n"))
    found = sorted((bytes(r.pattern), r.n) for r in counted.collect())  # at most 3 ** labellers rows
    kinds = np.array([np.frombuffer(p, np.int8) for p, _ in found]).reshape(len(found), len(LABELLERS))
    post, _, _ = fit_labellers(kinds, np.array([n for _, n in found], float), cfg.em_rounds)
    posterior = dict(zip((p for p, _ in found), post.tolist(), strict=True))

    # The sample is of distinct texts, each with its number of rows: a hot text is one of them.
    sampled = voted.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(cfg.sample).collect()
    weight = {r.h: min(r.n, cfg.most_weight) for r in sampled}
    chosen = rows.where(F.xxhash64("text") <= F.lit(max(weight))) if weight else rows.limit(0)

    def features(it):
        for batch in it:
            for lo, hi, raw, offs in K.row_ranges(batch.column("text")):
                v = votes(raw, offs)
                x = hashed(raw, offs, cfg.dims).astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("h").slice(lo, hi - lo),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array([posterior[r.tobytes()] for r in v], pa.float64()),
                    ],
                    ["h", "x", "y"],
                )

    # Rows of one text are merged before they are gathered; different texts of one hash would be too.
    merged = chosen.groupBy(text_hash).agg(F.first("text").alias("text"))
    learnt = sorted(merged.mapInArrow(features, "h long, x binary, y double").collect())
    if learnt:
        x = np.frombuffer(b"".join(bytes(r.x) for r in learnt), "<f2").reshape(len(learnt), cfg.dims).astype(np.float32)
        weights = train(x, np.array([r.y for r in learnt]), np.array([weight[r.h] for r in learnt], float), cfg)
    else:
        weights = np.zeros(cfg.dims + 1)
    shared = docs.sparkSession.sparkContext.broadcast((weights, posterior))  # `dims` numbers and the patterns

    def score(it):
        w, known = shared.value
        sign = {1: "+", 0: "0", -1: "-"}
        for batch in it:
            for lo, hi, raw, offs in K.row_ranges(batch.column("text")):
                v = votes(raw, offs)
                s = 1 / (1 + np.exp(-(hashed(raw, offs, cfg.dims) @ w[:-1] + w[-1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(["".join(sign[x] for x in r) for r in v.tolist()]),
                        pa.array([known[r.tobytes()] for r in v], pa.float64()),
                        pa.array(s, pa.float64()),
                    ],
                    ["doc_id", "votes", "weak_label", "score"],
                )

    out = rows.mapInArrow(score, "doc_id long, votes string, weak_label double, score double")
    return out.withColumn("kept", (F.col("weak_label") + F.col("score")) / 2 >= cfg.threshold)
