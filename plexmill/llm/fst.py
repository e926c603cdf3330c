"""Token counts by a compiled finite-state transducer.

A merge vocabulary is compiled, as far as texts call for it, into a deterministic
transducer over characters.  Its transitions carry the change of the token count
of the text read so far, so the sum over a text is its token count.  A state
holds what later characters can still depend on: for each earlier place where an
unfinished vocabulary piece may begin, the piece's node in the trie, the token
that ends there and the count there relative to now, and the token that ends now.

The transducer is right because the encoding of any prefix is fixed by its last
token, and a token t may follow a token s just if the merges of s + t give s, t
(`MergeTable.may_follow`): pairs decide, so finitely many states do.

Texts are cut where a white-space run begins and at characters without a piece:
there the transducer is back in its start state, so such a chunk's state map is
constant.  Longer stretches are cut in chunks of fixed size.  A chunk's map takes
the states that it may be entered in to the state it ends in and its count; these
states are the start state and whatever the chunk before may end in.  The maps
are composed by a parallel prefix scan, in as many rounds as the logarithm of the
number of chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import bound_batches

SPACE = "▁"
_INF = 1 << 30


@dataclass
class MergeTable:
    """What the merges of a vocabulary do: built once on the driver, bounded by the vocabulary."""

    pieces: list[str]  # normal pieces, best score first
    rank: dict[str, int]
    split: list[tuple[int, int] | None]  # parts of the last merge; None for one character
    when: list[int]  # order of each piece's merge; runs of spaces share one score, and so the last place

    @classmethod
    def load(cls, path: str) -> MergeTable:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i
            for i in range(sp.vocab_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        text = {i: sp.id_to_piece(i) for i in normal}
        is_run = lambda i: len(text[i]) > 1 and set(text[i]) == {SPACE}
        normal.sort(key=lambda i: (is_run(i), -sp.get_score(i), i))
        pieces = [text[i] for i in normal]
        runs = sum(map(is_run, normal))
        when = [min(r, len(pieces) - max(1, runs)) for r in range(len(pieces))]
        table = cls(pieces, {p: r for r, p in enumerate(pieces)}, [None] * len(pieces), when)
        table._split()
        return table

    def _split(self) -> None:
        """Parts of each piece's last merge, from short pieces to long; unreachable pieces go."""
        for p in sorted(self.pieces, key=len):
            if len(p) == 1:
                continue
            r = self.rank[p]
            for at in range(1, len(p)):
                a, b = self.rank.get(p[:at]), self.rank.get(p[at:])
                if a is not None and b is not None and self.may_follow(a, b, besides=r):
                    self.split[r] = (a, b)
                    break
            else:
                del self.rank[p]

    def _edge(self, t: int, side: int) -> list[tuple[int, int, int]]:
        """(symbol, made at, merged away at) for the symbols that come to stand at one end of t."""
        out = []
        end = _INF
        while True:
            s = self.split[t]
            out.append((t, -1 if s is None else self.when[t], end))
            if s is None:
                return out
            end, t = self.when[t], s[side]

    def may_follow(self, s: int, t: int, besides: int = -1) -> bool:
        """No merge across the border comes up before the merges that make s and t end.

        Of equal merges the leftmost comes first.
        """
        right = self._edge(t, 0)
        for a, a_from, a_to in self._edge(s, 1):
            for b, b_from, b_to in right:
                if max(a_from, b_from) >= min(a_to, b_to):
                    continue
                c = self.rank.get(self.pieces[a] + self.pieces[b])
                if c is None or c == besides and a == s and b == t:
                    continue
                c = self.when[c]
                at = max(c, a_from, b_from)
                if at < a_to and (at < b_to or at == c == b_to):
                    return False
        return True


class Transducer:
    """The compiled part of the transducer, as an open-addressed table of transitions."""

    def __init__(self, table: MergeTable, log_size: int = 22):
        self.table = table
        alphabet = sorted({c for p in table.rank for c in p})
        self.symbol = np.full(0x110000, -1, np.int32)
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.space = int(self.symbol[ord(SPACE)])
        code = {c: i for i, c in enumerate(alphabet)}
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for p, r in table.rank.items():
            node = 0
            for c in p:
                node = self.child[node].setdefault(code[c], len(self.child))
                if node == len(self.token):
                    self.child.append({})
                    self.token.append(-1)
            self.token[node] = r
        self.follows: dict[tuple[int, int], bool] = {}
        self.log_size = log_size
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.log_size
        self.keys = np.full(n, -1, np.int64)
        self.next = np.zeros(n, np.int32)
        self.delta = np.zeros(n, np.int8)
        self.filled = 0
        start = ((), -1)
        self.states = [start]
        self.index = {start: 0}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the free place where it belongs."""
        mask = np.uint64((1 << self.log_size) - 1)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log_size)).astype(np.int64)
        held = self.keys[at]
        away = np.flatnonzero((held != keys) & (held != -1))
        while len(away):
            at[away] = (at[away] + 1) & int(mask)
            held = self.keys[at[away]]
            away = away[(held != keys[away]) & (held != -1)]
        return at

    def _compile(self, state: int, c: int) -> tuple[int, int]:
        """(next state, change of the count) for character c, by the rule of last tokens."""
        items, last = self.states[state]
        found = None
        grown = []
        for node, before, rel in (*items, (0, last, 0)):
            to = self.child[node].get(c)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and found is None:
                pair = (before, t)
                ok = before < 0 or self.follows.get(pair)
                if ok is None:
                    ok = self.follows[pair] = self.table.may_follow(before, t)
                if ok:
                    found = (t, rel + 1)
            if self.child[to]:
                grown.append((to, before, rel))
        if found is None:
            raise ValueError("a prefix has no last token: the vocabulary's merges aren't ordered")
        t, delta = found
        after = (tuple((node, before, rel - delta) for node, before, rel in grown), t)
        got = self.index.get(after)
        if got is None:
            got = self.index[after] = len(self.states)
            self.states.append(after)
        return got, delta

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Slots of the transitions; compiles those met for the first time."""
        keys = (state.astype(np.int64) << 16) | c
        at = self._slots(keys)
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            fresh = np.unique(keys[new])
            for k in fresh.tolist():
                to, delta = self._compile(k >> 16, k & 0xFFFF)
                slot = int(self._slots(np.array([k]))[0])
                self.keys[slot], self.next[slot], self.delta[slot] = k, to, delta
            self.filled += len(fresh)
            at = self._slots(keys)
        return at

    def _run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end states, counts) of stretches, from given states, all in step; longest first."""
        state = state.copy()
        count = np.zeros(len(start), np.int64)
        live = len(start)
        steps = int(length[0]) if live else 0
        still = np.searchsorted(-length, -np.arange(steps), "left")
        for k in range(steps):
            live = int(still[k])
            at = self._step(state[:live], symbols[start[:live] + k])
            state[:live] = self.next[at]
            count[:live] += self.delta[at]
        return state, count

    def counts(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, chunk: int = 128) -> np.ndarray:
        """Tokens of each stretch symbols[start:end], begun in the start state."""
        if self.filled > (1 << self.log_size) // 2 or len(self.states) > 1 << 21:
            self._clear()
        parts = np.maximum(1, -(-(end - start) // chunk))
        owner = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = start[owner] + nth * chunk
        length = np.minimum(end[owner] - at, chunk)
        # Maps, as rows (chunk, entry state) -> (end state, count).  First each chunk from the start state.
        part, entry = np.arange(len(owner)), np.zeros(len(owner), np.int32)
        done, count = self._run_any(symbols, at, length, entry)
        if len(owner) == len(start):
            return count
        follows = np.append(owner[1:] == owner[:-1], False)  # the stretch goes on in the next chunk
        key = lambda p, s: p.astype(np.int64) << 32 | s
        have = key(part, entry)
        fresh = np.flatnonzero(follows[part])
        while len(fresh):  # what chunks end in, the next ones may be entered in
            new = np.setdiff1d(key(part[fresh] + 1, done[fresh]), have)
            p, s = new >> 32, (new & 0xFFFFFFFF).astype(np.int32)
            ended, counted = self._run_any(symbols, at[p], length[p], s)
            fresh = len(part) + np.flatnonzero(follows[p])
            part, entry, have = np.append(part, p), np.append(entry, s), np.append(have, new)
            done, count = np.append(done, ended), np.append(count, counted)
        # The scan: each row's map is composed with that of the row it leads to, over ever longer stretches.
        order = np.argsort(have)
        goes = follows[part]
        to = np.where(goes, order[np.minimum(np.searchsorted(have[order], key(part + 1, done)), len(order) - 1)], -1)
        while (to >= 0).any():
            on = np.flatnonzero(to >= 0)
            count[on], to[on] = count[on] + count[to[on]], to[to[on]]
        return count[: len(owner)][nth == 0]

    def _run_any(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-length, kind="stable")
        done, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        done[order], count[order] = self._run(symbols, start[order], length[order], state[order])
        return done, count


class PieceCounter:
    """Token counts as the sentencepiece library's for a BPE model with byte fallback."""

    def __init__(self, table: MergeTable):
        self.transducer = Transducer(table)

    def count(self, raw: np.ndarray, offsets: np.ndarray, begun: bool = False) -> np.ndarray:
        """Tokens of each text of a buffer; `begun`: the one text goes on, at white space, with a text counted before."""
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        if len(raw) == 0:
            return out
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        bounds = lead[offsets]
        # The library puts a space before every text that isn't empty.
        filled = (bounds[1:] > bounds[:-1]) & (not begun)
        points = np.insert(points, bounds[:-1][filled], ord(" "))
        bounds = bounds + np.append(0, np.cumsum(filled))
        symbols = self.transducer.symbol[points]
        space = symbols == self.transducer.space
        known = symbols >= 0
        m = len(points)
        wide = np.ones(m, np.int64)  # bytes of an unknown character
        wide += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        text_of = np.searchsorted(bounds, np.arange(m), "right") - 1
        unknown = np.flatnonzero(~known)
        np.add.at(out, text_of[unknown], wide[unknown])
        first = np.zeros(m, bool)
        first[bounds[:-1][filled]] = True
        before_space = np.append(False, space[:-1]) & ~first
        before_known = np.append(False, known[:-1]) & ~first
        begins = (space & ~before_space) | (known & ~space & ~before_known) | (known & first)
        start = np.flatnonzero(begins)
        stop = begins | ~known
        stops = np.append(np.flatnonzero(stop), m)
        end = stops[np.searchsorted(stops, start, "right")]
        counts = self.transducer.counts(symbols, start, end)
        np.add.at(out, text_of[start], counts)
        return out


_kept: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of `docs`.

    `model` is the path of a BPE model file of the sentencepiece library.  Defined
    cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null;
    repeated rows are returned as often as they occur; an empty table gives an empty
    result; other columns are ignored.  A long text is counted in pieces cut at blanks.
    """
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(MergeTable.load(model))  # as large as the vocabulary

    def run(it):
        if model not in _kept:
            _kept[model] = PieceCounter(table.value)
        counter = _kept[model]
        for batch in it:
            before = np.zeros(2, np.int64)  # bytes and tokens of the pieces before of a long text
            for lo, hi, raw, offs, more in K.row_pieces(batch.column("text")):
                n = np.stack([np.diff(offs), counter.count(raw, offs, before[0] > 0)]) + before[:, None]
                before = n[:, 0] if more else np.zeros(2, np.int64)
                if not more:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo), pa.array(n[0]), pa.array(n[1])], ["doc_id", "n_bytes", "n_tokens"]
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
