"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words of letters and their first 4 and 5 characters.  A bounded sample of
labelled rows is searched in two spaces, in both for the exact nearest.

The space of whole texts has every term.  A text is near to an example if their
cosine reaches `near`.  Rare terms have inverted lists, which give their part of
every cosine; for frequent terms the product of both norms bounds the rest, and
only examples whose bound reaches `near` are computed in full.

The space of telling terms has those that tell labels apart by a likelihood ratio:
a term, a term found at least 2, 3 or 5 times in a text, and a term found in a text
twice or more at some rate, in powers of two.  Its vectors, equal ones merged, form an
inverted index in blocks with the largest weight of each term in each block.  A
query adds up these bounds, takes blocks from the highest bound down and stops when
no further block can hold a nearer example.

Neighbours vote with weights that fall with distance; a prior keeps few and far ones
from certainty.  The vote by telling terms is the prior of the vote by whole texts, which
moves it both ways.  It lowers a score by the votes of those neighbours only that hold all
telling terms of the text: to be like a clean text but for a few toxic words is no sign of
being clean.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .storage import Workspace


@dataclass(frozen=True)
class ToxicityConfig:
    sample: int = 6_000  # labelled texts that are learnt from, the first by a hash of id and text
    sample_mb: int = 48  # of their texts together; a text that would exceed it is passed over
    prefixes: tuple[int, ...] = (4, 5)
    levels: tuple[int, ...] = (2, 3, 5)
    lean: float = 2.0  # times the share of toxic rows that a telling term has
    neighbours: int = 15
    block: int = 64
    sharpness: int = 4
    prior_votes: float = 0.5
    near: float = 0.5  # least cosine of whole texts that votes
    frequent: float = 0.05  # share of the examples from which on a term has no inverted list
    softness: float = 0.05  # added to the distance of whole texts that a vote is divided by
    threshold: float = 0.7


_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[0x80:] = True
_HEAD = np.uint64(0x5851F42D4C957F2D)
_VARIANT = 0xD6E8FEB86659FD93


@dataclass
class Terms:
    """Terms of some texts: text `owner[k]` has `hashes[term[k]]` `count[k]` times; by owner and term."""

    hashes: np.ndarray
    owner: np.ndarray
    term: np.ndarray
    count: np.ndarray
    words: np.ndarray  # of each text


def _terms(raw: np.ndarray, offsets: np.ndarray, cfg: ToxicityConfig) -> Terms:
    raw = K.lowered(raw)
    w = K.words(raw, offsets, _LETTERS)
    owner = np.repeat(np.arange(len(offsets) - 1), w.counts())
    char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at = np.searchsorted(char, w.start)
    owners, hashes = [owner], [w.hash]
    for n in cfg.prefixes:
        stop = char[np.minimum(at + n, len(char) - 1)]
        longer = stop < w.end
        owners.append(owner[longer])
        hashes.append(K.range_hash(raw, w.start[longer], stop[longer]) ^ _HEAD)
    seen, back = np.unique(np.concatenate(hashes), return_inverse=True)
    key, count = np.unique(np.concatenate(owners) * max(1, len(seen)) + back, return_counts=True)
    return Terms(seen, key // max(1, len(seen)), key % max(1, len(seen)), count, w.counts())


def _text_terms(column: pa.Array, cfg: ToxicityConfig):
    """(lo, hi, Terms) for ranges of rows; a long text is read in pieces and its terms are added up."""
    held: list[Terms] = []
    for lo, hi, raw, offs, more in K.row_pieces(column):
        t = _terms(raw, offs, cfg)
        if more or held:
            held.append(t)
        if more:
            continue
        if held:
            seen, back = np.unique(np.concatenate([x.hashes[x.term] for x in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x.count for x in held]), len(seen)).astype(np.int64)
            words = sum(x.words for x in held)
            t, held = Terms(seen, np.zeros(len(seen), np.int64), np.arange(len(seen)), n, words), []
        yield lo, hi, t


def _variants(h: np.ndarray, count: np.ndarray, words: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each term and of its variants: at the levels it reaches, and at its rate if repeated."""
    place = np.arange(len(h))
    out = [(place, h)]
    for n in cfg.levels:
        hit = np.flatnonzero(count >= n)
        out.append((hit, K.mix64(h[hit] + np.uint64(n * _VARIANT % (1 << 64)))))
    hit = np.flatnonzero(count >= 2)
    rate = np.floor(np.log2(count[hit] * 1000 / words[hit])).astype(np.int64)
    out.append((hit, K.mix64(h[hit] - (rate + 100).astype(np.uint64) * np.uint64(_VARIANT))))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _term_rows(cfg: ToxicityConfig):
    """Labelled texts to (term, root, rows, toxic): document frequencies of all variants, summed over a batch."""

    def run(it):
        for batch in it:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, t in _text_terms(batch.column("text"), cfg):
                place, h = _variants(t.hashes[t.term], t.count, t.words[t.owner], cfg)
                terms, first, back = np.unique(h, return_index=True, return_inverse=True)
                bad = label[lo:hi][t.owner[place]].astype(float)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(terms.view(np.int64)),
                        pa.array(t.hashes[t.term[place[first]]].view(np.int64)),
                        pa.array(np.bincount(back, minlength=len(terms)).astype(np.int64)),
                        pa.array(np.bincount(back, bad, len(terms)).astype(np.int64)),
                    ],
                    ["term", "root", "rows", "toxic"],
                )

    return run


def _example_rows(cfg: ToxicityConfig):
    """Examples with the sorted hashes of all their terms, the terms' frequencies and their number of words."""

    def run(it):
        for batch in it:
            for lo, hi, t in _text_terms(batch.column("text"), cfg):
                cut = np.searchsorted(t.owner, np.arange(hi - lo + 1)).tolist()
                h, n = t.hashes[t.term].astype("<u8").tobytes(), t.count.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("toxic").slice(lo, hi - lo),
                        pa.array([h[8 * a : 8 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([n[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array(t.words.astype(np.int64)),
                    ],
                    ["doc_id", "toxic", "terms", "counts", "words"],
                )

    return run


def _ratio(a: F.Column, n: F.Column, p: float) -> F.Column:
    """Log-likelihood ratio of `a` toxic of `n` rows against the share p."""
    b = n - a
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * F.lit(q)))).otherwise(0.0)
    return 2 * (part(a, p) + part(b, 1 - p))


class BlockMaxIndex:
    """Distinct example vectors in blocks, with the largest weight of each term in each block.

    A vector has its terms' inverse document frequencies, at unit length.
    """

    def __init__(self, n_terms: int, examples: list[tuple[int, int, bytes]], cfg: ToxicityConfig):
        """examples: id, label, sorted numbers of the telling terms (int32, packed)."""
        self.cfg = cfg
        merged: dict[bytes, list[int]] = {}
        self.empty = [0, 0]  # rows, toxic rows without any term
        df = np.zeros(n_terms)
        for doc, toxic, terms in sorted(examples):
            df[np.frombuffer(terms, "<i4")] += 1
            if not terms:
                self.empty[0] += 1
                self.empty[1] += toxic
                continue
            own = merged.setdefault(terms, [0, 0, doc])
            own[0] += 1
            own[1] += toxic
        self.idf = np.log((len(examples) + 1) / (df + 1)) + 1
        # Like vectors lie together, so that few blocks hold a term.
        keys = sorted(merged, key=lambda k: np.frombuffer(k, "<i4").tolist())
        self.rows = np.array([merged[k][0] for k in keys], float)
        self.toxic = np.array([merged[k][1] for k in keys], float)
        self.doc = np.array([merged[k][2] for k in keys], np.int64)
        term = np.frombuffer(b"".join(keys), "<i4").astype(np.int64)
        where = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys]) if keys else np.zeros(0, np.int64)
        weight = self.idf[term] / np.sqrt(np.bincount(where, self.idf[term] ** 2, len(keys)))[where]
        order = np.lexsort((where, term))
        self.where, self.weight = where[order], weight[order]
        self.blocks = -(-len(keys) // cfg.block)
        spot = term[order] * self.blocks + self.where // cfg.block
        self.start = np.searchsorted(spot, np.arange(n_terms * self.blocks + 1))
        top = np.zeros(n_terms * self.blocks)
        np.maximum.at(top, spot, self.weight)
        self.top = top.reshape(n_terms, self.blocks)
        n, bad = self.rows.sum(), self.toxic.sum()
        everyone = (bad + self.empty[1] + 1) / (n + self.empty[0] + 2)
        self.prior = (bad + everyone) / (n + 1)
        self.prior_empty = (self.empty[1] + everyone) / (self.empty[0] + 1)
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def nearest(self, terms: np.ndarray) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest, by cosine and then position: exact."""
        w = self.idf[terms] / np.sqrt((self.idf[terms] ** 2).sum())
        bound = w @ self.top[terms]
        best: list[tuple[float, int]] = []
        k, size = self.cfg.neighbours, self.cfg.block
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-12):
                break
            got = np.zeros(size)
            for t, q in zip(terms.tolist(), w.tolist(), strict=True):
                lo, hi = self.start[t * self.blocks + b], self.start[t * self.blocks + b + 1]
                got[self.where[lo:hi] - b * size] += q * self.weight[lo:hi]
            hit = np.flatnonzero(got > 0)
            best = sorted([*best, *((float(got[i]), b * size + int(i)) for i in hit)], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def score(self, terms: bytes) -> tuple[float, list[int]]:
        """Calibrated score and the ids of the three nearest examples."""
        if not terms:
            return self.prior_empty, []
        got = self.known.get(terms)
        if got is None:
            near = self.nearest(np.frombuffer(terms, "<i4"))
            vote = np.array([c for c, _ in near]) ** self.cfg.sharpness
            i = np.array([x for _, x in near], int)
            m = self.cfg.prior_votes
            got = (
                float(((vote * self.toxic[i]).sum() + m * self.prior) / ((vote * self.rows[i]).sum() + m)),
                self.doc[i[:3]].tolist(),
            )
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[terms] = got
        return got


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Small whole numbers, compressed byte by byte of their width."""
    raw = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values), pa.compress(raw, "zstd", asbytes=True)


def _unpacked(n: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


@dataclass
class ExampleRows:
    """The labelled examples: example i has `terms` (sorted hashes) and `counts` from cut[i] to cut[i + 1]."""

    doc: np.ndarray
    toxic: np.ndarray
    words: np.ndarray
    cut: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, table: pa.Table) -> ExampleRows:
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)

        def flat(c, kind):
            x = column(c)
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            x = x.cast(pa.large_binary())
            if not len(x):
                return np.zeros(1, np.int64), np.zeros(0, kind)
            _, offs, data = x.buffers()
            offs = np.frombuffer(offs, np.int64)[x.offset : x.offset + len(x) + 1]
            return offs, np.frombuffer(data or b"", np.uint8)[offs[0] : offs[-1]].view(kind)

        offs, terms = flat("terms", "<u8")
        _, counts = flat("counts", "<i4")
        doc, toxic, words = (np.array(column(c).to_pylist(), np.int64) for c in ("doc_id", "toxic", "words"))
        return cls(doc, toxic, words, (offs - offs[0]) // 8, terms, counts)


class WholeTextIndex:
    """Distinct example texts over all of their terms.

    Rare terms have lists of examples, frequent ones are kept by example.  Both are sent as
    compressed numbers; weights are made where they are used.
    """

    def __init__(self, rows: ExampleRows, cfg: ToxicityConfig):
        self.cfg = cfg
        merged: dict[bytes, list[int]] = {}
        first: list[int] = []
        for i in np.lexsort((rows.toxic, rows.doc)).tolist():
            lo, hi = rows.cut[i], rows.cut[i + 1]
            if lo < hi:
                key = hashlib.blake2b(rows.terms[lo:hi].data, digest_size=16)
                key.update(rows.counts[lo:hi].data)
                own = merged.setdefault(key.digest(), [0, 0])
                if not own[0]:
                    first.append(i)
                own[0] += 1
                own[1] += int(rows.toxic[i])
        self.rows, self.toxic = (np.array([x[k] for x in merged.values()], float) for k in (0, 1))
        self.first = first
        self.doc = rows.doc[first]
        size = np.diff(rows.cut)[first]
        where = np.repeat(np.arange(len(size), dtype=np.int32), size)
        spans = [slice(rows.cut[i], rows.cut[i + 1]) for i in first]
        none = [np.zeros(0, np.uint64)]
        h = np.concatenate([rows.terms[x] for x in spans] or none)
        n = np.concatenate([rows.counts[x] for x in spans] or none).astype(np.int32)
        self.terms = np.unique(h)
        term = np.empty(len(h), np.int32)
        for lo in range(0, len(h), 1 << 20):
            term[lo : lo + (1 << 20)] = np.searchsorted(self.terms, h[lo : lo + (1 << 20)])
        del h
        df = np.bincount(term, self.rows[where], minlength=len(self.terms))
        self.idf = (np.log((len(rows.doc) + 1) / (df + 1)) + 1).astype(np.float32)
        self.idf_other = float(np.log(len(rows.doc) + 1) + 1)
        in_texts = np.bincount(term, minlength=len(self.terms))
        #: Number among the frequent terms, -1 for a rare one.
        self.column = np.full(len(self.terms), -1, np.int32)
        frequent = np.flatnonzero(in_texts >= max(2, cfg.frequent * len(size)))
        self.column[frequent] = np.arange(len(frequent))
        often = self.column[term] >= 0
        squares, often_squares = np.zeros(len(size)), np.zeros(len(size))
        for lo in range(0, len(term), 1 << 20):
            part = slice(lo, lo + (1 << 20))
            w = ((1 + np.log(n[part].astype(float))) * self.idf[term[part]]) ** 2
            squares += np.bincount(where[part], w, len(size))
            often_squares += np.bincount(where[part], w * often[part], len(size))
        self.norm = np.sqrt(squares)
        self.often_norm = np.sqrt(often_squares) / np.maximum(self.norm, 1e-300)
        self.often_first = np.concatenate([[0], np.cumsum(np.bincount(where[often], minlength=len(size)))])
        self.rare_first = np.concatenate([[0], np.cumsum(np.where(self.column < 0, in_texts, 0))]).astype(np.int32)
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.sent = [_packed(x) for x in (np.diff(where[rare], prepend=np.int32(0)), n[rare], self.column[term[often]], n[often])]

    def build(self) -> None:
        where, n, column, m = (_unpacked(*x) for x in self.sent)
        self.sent = None
        self.rare_where = np.cumsum(where, dtype=np.int32)
        self.often_column = column
        self.rare_weight, self.often_weight = np.empty(len(n), np.float32), np.empty(len(m), np.float32)
        frequent = self.idf[self.column >= 0]
        for lo in range(0, len(n), 1 << 20):
            hi = min(len(n), lo + (1 << 20))
            term = np.searchsorted(self.rare_first, np.arange(lo, hi), "right") - 1
            self.rare_weight[lo:hi] = (1 + np.log(n[lo:hi])) * self.idf[term] / self.norm[self.rare_where[lo:hi]]
        for lo in range(0, len(m), 1 << 20):
            hi = min(len(m), lo + (1 << 20))
            where = np.searchsorted(self.often_first, np.arange(lo, hi), "right") - 1
            self.often_weight[lo:hi] = (1 + np.log(m[lo:hi])) * frequent[column[lo:hi]] / self.norm[where]
        self.mine = np.zeros(len(frequent))

    def nearest(self, cut: np.ndarray, term: np.ndarray, count: np.ndarray, others: np.ndarray):
        """For each text, the cosines and examples of the nearest of those near, by cosine and then position: exact.

        Text i has terms cut[i]:cut[i + 1]; others[i] sums the squares of 1 + log(frequency) of terms that no example has.
        """
        if self.sent is not None:
            self.build()
        texts, examples, near = len(cut) - 1, len(self.rows), self.cfg.near
        w = (1 + np.log(count)) * self.idf[term]
        owner = np.repeat(np.arange(texts), np.diff(cut))
        norm = np.sqrt(np.bincount(owner, w * w, minlength=texts) + others * self.idf_other**2)
        w = w / norm[owner]
        column = self.column[term]
        often = column >= 0
        often_norm = np.sqrt(np.bincount(owner[often], w[often] ** 2, minlength=texts))
        first, last = self.rare_first[term], self.rare_first[term + 1]
        for i in range(texts):
            lo, hi = cut[i], cut[i + 1]
            o = often[lo:hi]
            a, b = first[lo:hi][~o], last[lo:hi][~o]
            if len(a):
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
                part = np.concatenate([self.rare_weight[x:y] for x, y in spans]) * np.repeat(w[lo:hi][~o], b - a)
                got = np.bincount(np.concatenate([self.rare_where[x:y] for x, y in spans]), part, minlength=examples)
            else:
                got = np.zeros(examples)
            at = np.flatnonzero(got + often_norm[i] * self.often_norm >= near - 1e-6)
            if not len(at):
                yield np.zeros(0), at
                continue
            cosine = got[at]
            if o.any():
                self.mine[column[lo:hi][o]] = w[lo:hi][o]
                begin, size = self.often_first[at], self.often_first[at + 1] - self.often_first[at]
                ends = np.cumsum(size)
                place = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
                cosine = cosine + np.bincount(
                    np.repeat(np.arange(len(at)), size), self.mine[self.often_column[place]] * self.often_weight[place], len(at)
                )
                self.mine[column[lo:hi][o]] = 0
            hit = cosine >= near
            at, cosine = at[hit], cosine[hit]
            order = np.lexsort((at, -cosine))[: self.cfg.neighbours]
            yield cosine[order], at[order]

    def voted(self, prior: float, cosine: np.ndarray, at: np.ndarray) -> tuple[float, list[int]]:
        """The vote of the nearest examples with a prior, and the ids of the three nearest."""
        vote = cosine**self.cfg.sharpness / (np.maximum(0, 1 - cosine) + self.cfg.softness)
        m = self.cfg.prior_votes
        return float(((vote * self.toxic[at]).sum() + m * prior) / ((vote * self.rows[at]).sum() + m)), self.doc[at[:3]].tolist()


def _index_of(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, -1 where it isn't there."""
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


class Examples:
    """The labelled examples in both spaces."""

    def __init__(self, telling: np.ndarray, roots: np.ndarray, rows: ExampleRows, cfg: ToxicityConfig):
        """telling: sorted hashes of the telling terms and variants; roots: sorted hashes of the terms that have one."""
        self.cfg = cfg
        self.tellers, self.roots = telling, roots
        part = []
        for i, (doc, toxic) in enumerate(zip(rows.doc.tolist(), rows.toxic.tolist(), strict=True)):
            own = slice(rows.cut[i], rows.cut[i + 1])
            h = rows.terms[own]
            _, at = self._telling(np.zeros(len(h), np.int64), h, rows.counts[own], rows.words[i : i + 1])
            part.append((doc, toxic, at.astype("<i4").tobytes()))
        self.telling = BlockMaxIndex(len(telling), part, cfg)
        self.whole = WholeTextIndex(rows, cfg)
        held = [np.frombuffer(part[i][2], "<i4") for i in self.whole.first]
        self.held_cut = np.cumsum([0, *map(len, held)])
        self.held = np.concatenate([*held, np.zeros(0, "<i4")])

    def _holding(self, telling: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the examples `at` hold all of some telling terms."""
        size = self.held_cut[at + 1] - self.held_cut[at]
        spans = [self.held[lo:hi] for lo, hi in zip(self.held_cut[at].tolist(), self.held_cut[at + 1].tolist(), strict=True)]
        common = np.isin(np.concatenate(spans), telling)
        return np.bincount(np.repeat(np.arange(len(at)), size), common, len(at)) == len(telling)

    def _telling(self, owner: np.ndarray, h: np.ndarray, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, number) of the telling terms of texts, by owner and number."""
        hit = np.flatnonzero(_index_of(self.roots, h) >= 0)
        place, v = _variants(h[hit], count[hit], words[owner[hit]], self.cfg)
        at = _index_of(self.tellers, v)
        owner, at = owner[hit][place][at >= 0], at[at >= 0]
        order = np.lexsort((at, owner))
        return owner[order], at[order]

    def scores(self, t: Terms, step: int = 256):
        """Score and ids of the nearest examples of each text."""
        texts = len(t.words)
        index = _index_of(self.whole.terms, t.hashes)[t.term]
        has_root = (_index_of(self.roots, t.hashes) >= 0)[t.term]
        own, telling = self._telling(t.owner[has_root], t.hashes[t.term[has_root]], t.count[has_root], t.words)
        own_cut = np.searchsorted(own, np.arange(texts + 1))
        telling = telling.astype("<i4")
        known = index >= 0
        others = np.bincount(t.owner[~known], (1 + np.log(t.count[~known])) ** 2, minlength=texts)
        owner, term, count = t.owner[known], index[known], t.count[known]
        cut = np.searchsorted(owner, np.arange(texts + 1))
        for lo in range(0, texts, step):
            hi = min(texts, lo + step)
            a, b = cut[lo], cut[hi]
            near = self.whole.nearest(cut[lo : hi + 1] - a, term[a:b], count[a:b], others[lo:hi])
            for i, (cosine, at) in zip(range(lo, hi), near, strict=True):
                score, evidence = self.telling.score(telling[own_cut[i] : own_cut[i + 1]].tobytes())
                if len(at):
                    voted, nearest = self.whole.voted(score, cosine, at)
                    if voted < score:
                        own = self._holding(telling[own_cut[i] : own_cut[i + 1]], at)
                        lower, nearer = self.whole.voted(score, cosine[own], at[own]) if own.any() else (score, nearest)
                        voted, nearest = (lower, nearer) if lower < score else (score, nearest)
                    if voted != score or not evidence:
                        score, evidence = voted, nearest
                yield score, evidence


def _scored(index, cfg: ToxicityConfig):
    def run(it):
        idx = index.value
        for batch in it:
            got = []
            for _, _, terms in _text_terms(batch.column("text"), cfg):
                got += idx.scores(terms)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),  # whole: a slice of a struct would be sent with all of its texts
                    pa.array([min(1.0, max(0.0, g[0])) for g in got], pa.float64()),
                    pa.array([g[1] for g in got], pa.list_(pa.int64())),
                ],
                [*keep, "score", "evidence"],
            )

    return run


def held_out(doc_id) -> F.Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> Examples:
    """The examples, from the labelled rows that aren't held out."""
    work = Workspace(docs.sparkSession, "toxicity")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(cfg.sample)
    )
    known = work.save(known, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most `sample` rows of two numbers: bounded, so it may be broadcast.  An id may stand in any number of rows, with
    # other texts: rows are told apart by 128 bits of the text, counted once, and the first `sample` of all are taken.
    labelled = texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text", *(F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in (1, 2)))
    key = ["doc_id", "toxic", "h1", "h2"]
    sizes = labelled.groupBy(*key).agg(F.first(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id", "h1"), *key).limit(cfg.sample)
    taken, room = [], cfg.sample_mb << 20
    for r in sizes.collect():  # `sample` rows of numbers
        if r["size"] <= room:
            room -= r["size"]
            taken.append((*(r[c] for c in key),))
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int, h1 long, h2 long")
    sample = labelled.join(F.broadcast(taken), key).groupBy(*key).agg(F.first("text").alias("text"))
    sample = work.save(sample.select("doc_id", "toxic", "text"), "sample")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not bad or bad == n:
        none = np.zeros(0, np.uint64)
        doc, toxic = (np.array(x, np.int64) for x in zip(*sample.select("doc_id", "toxic").collect(), strict=True)) if n else (np.zeros(0, np.int64),) * 2
        rows = ExampleRows(doc, toxic, np.zeros(n, np.int64), np.zeros(n + 1, np.int64), none, np.zeros(0, np.int32))
        return Examples(none, none, rows, cfg)
    counted = work.save(
        sample.select("text", "toxic")
        .mapInArrow(_term_rows(cfg), "term long, root long, rows long, toxic long")
        .groupBy("term", "root")
        .agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic")),
        "terms",
    )
    share = bad / n
    ratio = _ratio(F.col("toxic").cast("double"), F.col("rows").cast("double"), share)
    # As many false terms as true ones would pass by chance below twice the log of their number.
    least = 2 * float(np.log(max(2, counted.where("rows > 1").count())))
    # As few as the sample's rows can tell apart.
    picked = counted.where((F.col("toxic") > cfg.lean * share * F.col("rows")) & (ratio >= least)).select("term", "root").collect()
    terms, roots = (np.unique(np.array([r[c] for r in picked], np.int64).view(np.uint64)) for c in ("term", "root"))
    rows = sample.mapInArrow(_example_rows(cfg), "doc_id long, toxic int, terms binary, counts binary, words long").toArrow()
    work.drop(counted)
    made = Examples(terms, roots, ExampleRows.read(rows), cfg)
    del rows
    pa.default_memory_pool().release_unused()
    return made


def score_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples) and the columns `carry` for each row of `docs`.

    Only `labels` (doc_id, toxic) of rows that aren't held out are learnt from; a score
    depends on the text alone.  Defined cases: a text without a telling term starts from
    the share of toxic rows among such examples, which the nearest whole texts may raise;
    a null or empty text, or one without a letter, gets that share; a null doc_id stays
    null; of repeated labels the largest counts; without labels of both kinds all rows
    get the share of the label there is, or one half; an empty table gives an empty
    result; other columns are ignored; a long text is read in pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, cfg))  # at most `sample` examples
    keep = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in carry)]
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("score", "double").add("evidence", T.ArrayType(T.LongType()))
    return rows.mapInArrow(_scored(shared, cfg), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold.

    Null and empty texts and null ids are scored as in `score_toxicity`; rows that occur
    more than once stay or go together; an empty table gives an empty result; other columns,
    whatever their names, stay as they are.
    """
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row")
    )
    return score_toxicity(whole, labels, cfg, carry=("row",)).where(F.col("score") < cfg.threshold).select("row.*")


def decisions(scored: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
        "evidence",
    )
