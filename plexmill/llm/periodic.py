"""Periodic runs of words by a harmonic grid of longest common extensions.

A run of period p and at least four periods holds four points of any grid of step p, and
the words at those points agree.  For each p the words at neighbouring grid points are
compared; where three comparisons in a row agree, the longest common extensions of the
first two points, forward and backward, tell the stretch of period p around them.  Each
extension is a minimum over the common prefixes of neighbours in a suffix array (of the
words, and of the words reversed), read from a table of minima.  A stretch is taken at its
first grid point only, and of the periods of one stretch the smallest is its period, since
any other that it holds four times is a multiple.  All grids of n words have n log n points.

Documents are read side by side: a word's number holds for its document alone, so nothing
agrees across documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches


@dataclass(frozen=True)
class RunConfig:
    least_words: int = 6
    least_periods: int = 4  # 3 at least: grids need a pair of points in each run
    words_at_once: int = 1 << 16  # documents are read together up to as many words; a longer one alone
    points_at_once: int = 1 << 20


class Extensions:
    """Longest common extensions to the right in a sequence of numbers."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        levels, step = [rank.astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while n and rank.max() < n - 1:  # ranks by the first 2, 4, 8, ... numbers
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        # Common prefixes of neighbours in the suffix array, from the ranks by 2^k numbers.
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            live = np.flatnonzero((x < n) & (y < n))
            live = live[levels[k][x[live]] == levels[k][y[live]]]
            common[live] += 1 << k
            x[live] += 1 << k
            y[live] += 1 << k
        del levels
        self.minima = [common]  # by k: minima of 2^k neighbours
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            half = 1 << (len(self.minima) - 1)
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes from x and from y, x != y; 0 where one is empty."""
        out = np.zeros(len(x), np.int64)
        inside = np.flatnonzero((x < self.n) & (y < self.n))
        a, b = self.rank[x[inside]], self.rank[y[inside]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            row = self.minima[k]
            out[inside[own]] = np.minimum(row[lo[own]], row[hi[own] - (1 << k)])
        return out


def find_runs(s: np.ndarray, first: np.ndarray, cfg: RunConfig = RunConfig()) -> np.ndarray:
    """Rows (start, length, period) of the runs in s, by start and period.

    s holds documents end to end, longest first, document i at first[i]:first[i + 1]; no number
    occurs in two documents.
    """
    sizes = np.diff(first)
    most = int(sizes.max()) // cfg.least_periods if len(sizes) else 0
    agree = cfg.least_periods - 1  # neighbours on a grid that agree in a run
    found: list[np.ndarray] = []
    points: list[tuple[np.ndarray, int]] = []
    held = 0

    def settle():
        nonlocal held
        if not points:
            return
        x = np.concatenate([p for p, _ in points])
        period = np.repeat([q for _, q in points], [len(p) for p, _ in points])
        doc = np.searchsorted(first, x, "right") - 1
        hit = np.unique(doc)  # documents without agreeing points have no run and aren't searched
        part = np.concatenate([s[first[i] : first[i + 1]] for i in hit.tolist()])
        moved = first[hit] - np.cumsum([0, *sizes[hit][:-1]])
        x = x - moved[np.searchsorted(hit, doc)]
        back = Extensions(part[::-1])(len(part) - x, len(part) - x - period)  # of the words before x and before x + period
        at = np.flatnonzero(back < period)  # the stretch's first grid point
        x, period, back, doc = x[at], period[at], back[at], doc[at]
        length = back + period + Extensions(part)(x, x + period)
        ok = length >= np.maximum(cfg.least_words, cfg.least_periods * period)
        found.append(np.stack([x - back + moved[np.searchsorted(hit, doc)], length, period], axis=1)[ok])
        points.clear()
        held = 0

    # Documents of four periods and more stand in front.
    until = first[np.searchsorted(-sizes, -cfg.least_periods * np.arange(1, most + 1), "right")]
    for p in range(1, most + 1):
        grid = s[: until[p - 1] : p]
        same = grid[1:] == grid[:-1]
        m = len(same) - agree + 1
        if m <= 0:
            continue
        all_same = same[:m].copy()
        for k in range(1, agree):
            all_same &= same[k : k + m]
        at = np.flatnonzero(all_same)
        if len(at):
            points.append((at * p, p))
            held += len(at)
            if held >= cfg.points_at_once:
                settle()
    settle()
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the smallest period of each stretch
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] > 0


def strongest(runs: np.ndarray) -> int:
    """The run of the greatest length / period, compared exactly; of equal ones the first by start, then period."""
    rate = runs[:, 1] / runs[:, 2]
    near = np.flatnonzero(rate >= rate.max() * (1 - 1e-9)).tolist()
    return max(near, key=lambda i: (Fraction(int(runs[i, 1]), int(runs[i, 2])), -i))


_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _structs(rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN))


def _scan(cfg: RunConfig):
    def together(names: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        numbers: list[np.ndarray] = []
        above = 0
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for i in order:
            seen: dict[bytes, int] = {}
            own = np.fromiter((seen.setdefault(w, len(seen)) for w in docs[i]), np.int64, len(docs[i]))
            numbers.append(own + above)
            above += len(seen)
        first = np.cumsum([0, *(len(docs[i]) for i in order)])
        runs = find_runs(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), first, cfg)
        cut = np.searchsorted(runs[:, 0], first)
        mine = {}
        for k, i in enumerate(order):
            rows = runs[cut[k] : cut[k + 1]].copy()
            rows[:, 0] -= first[k]
            mine[i] = rows
        texts, best = [], []
        for i, words in enumerate(docs):
            rows = mine[i]
            if len(rows):
                gone = dropped(len(words), rows).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
                top = strongest(rows)
                best.append(dict(zip(("start", "length", "period"), rows[top].tolist(), strict=True)))
            else:
                best.append(None)
            texts.append(b" ".join(words))
        every = np.concatenate([mine[i] for i in range(len(docs))])
        offsets = np.cumsum([0, *(len(mine[i]) for i in range(len(docs)))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array([len(d) for d in docs], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _structs(every)),
                pa.array(best, _RUN),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    def run(it):
        for batch in it:
            names, docs, held = [], [], 0
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # at the six ASCII blanks
                if docs and held + len(words) > cfg.words_at_once:
                    yield together(names, docs)
                    names, docs, held = [], [], 0
                names.append(name)
                docs.append(words)
                held += len(words)
            if docs:
                yield together(names, docs)

    return run


SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, "
    "strongest struct<start long, length long, period long>, collapsed string"
)


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""doc_id, n_words, runs, strongest, collapsed for each row of `docs`.

    Words are `[^\x20\x09-\x0D]+`, numbered from 0 and compared by their bytes.  A run is a
    stretch of smallest period q that no neighbouring word extends, of `least_words` and
    `least_periods` * q words at least.  strongest is the run of the greatest length / period;
    of equal ones the first by start, then period.  collapsed holds the words, joined by one
    space, that lie in no run after its first period.  Defined cases: a null or empty text has
    no words, no runs, a null strongest and an empty collapsed text; a null doc_id stays null;
    repeated rows are returned as often as they occur; an empty table gives an empty result;
    other columns are ignored.  Nothing is shuffled.  A text is held whole by its task, with
    some 150 bytes for each of its words, and 200 more while a text with agreeing grid points
    is searched.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_scan(cfg), SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    r"""`text`, its tail made periodic where the checksum of the id says so.

    With h = crc32(decimal doc_id) and g = floor(h / 10): if h % 10 = 0, words i >= a become word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  A null id or text,
    or one without words, stays as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    blanks = r"[\x20\x09-\x0D]+"
    words = F.split(F.regexp_replace(text, rf"^{blanks}|{blanks}\z", ""), blanks)
    g = F.floor(h / 10).cast("long")
    n = F.size(words).cast("long")
    a = g % n
    # Arrays of one struct bind what would else be worked out anew for each word.
    one = F.array(F.struct(words.alias("words"), a.alias("a"), (n - a).alias("rest"), (3 + g % 8).alias("times")))
    two = F.transform(one, lambda x: F.struct(x["words"].alias("words"), x["a"].alias("a"), (1 + F.floor(x["rest"] / x["times"])).alias("p")))
    word = lambda x: lambda w, i: F.when(i >= x["a"], F.get(x["words"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))).otherwise(w)
    changed = F.transform(two, lambda x: F.array_join(F.transform(x["words"], word(x)), " "))[0]
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, hashes of the runs and the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
