import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from plexmill.llm import bytebpe, fst, kernels, packing, wordbpe

from .helpers import documents, texts

MODEL, RANKS, WORD = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "   ", "it's 's 'll'lx 'x' we've'd", "a  b\n\n  c \t", "▁a▁▁b", "12ab34 ½²", "\x85\xa0 a\x1c b", "Ünï ÀÉ×÷ß ﬁ İ ΑΣς", "foo<|endoftext|>bar", "don't'"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_transducer_counts_like_the_library(library):
    counter = fst.PieceCounter(fst.MergeTable.load(MODEL))
    all_ = ODD + [t or "" for _, t in texts()] + [" " * n + w for n in range(36) for w in ("the", "Qz", "(", "日")] + ["ab" * 900 + " " * 40 + "z", "the quick brown fox " * 50]
    raw, offs = kernels.text_buffer(pa.array(all_))
    assert counter.count(raw, offs).tolist() == [len(library.encode(t)) for t in all_]


def test_long_stretches_are_composed_from_chunks(library):
    counter = fst.PieceCounter(fst.MergeTable.load(MODEL))
    text = "".join("abcdefghij"[(k * k + k // 7) % 10] for k in range(5000))
    raw, offs = kernels.text_buffer(pa.array([text]))
    assert counter.count(raw, offs).tolist() == [len(library.encode(text))]


def test_token_counts_of_awkward_documents(spark, library):
    got = fst.token_counts(documents(spark), MODEL, 4096).collect()
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in texts())
    assert sorted((g.doc_id or -1, g.n_bytes, g.n_tokens) for g in got) == want
    assert all(g.over_limit == (g.n_tokens > 4096) for g in got)
    assert fst.token_counts(documents(spark, []), MODEL).collect() == []


def test_pre_tokens_encode_like_the_library():
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    all_ = ODD + [t or "" for _, t in texts()]
    raw, offs = kernels.text_buffer(pa.array(all_))
    start, end, first = bytebpe.pre_tokens(raw, offs, P.PATTERN)
    data = raw.tobytes()
    for i, t in enumerate(all_):
        ids = [x for k in range(first[i], first[i + 1]) for x in enc.encode_ordinary(data[start[k] : end[k]].decode())]
        assert ids == enc.encode_ordinary(t), t


def test_encoding_and_decoding_round_trip(spark):
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    got = bytebpe.digest(bytebpe.encode_and_decode(documents(spark), RANKS, P.PATTERN)).collect()
    want = []
    for i, t in texts():
        ids = enc.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((g.doc_id or -1, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    assert bytebpe.encode_and_decode(documents(spark, []), RANKS, P.PATTERN).collect() == []


def colliding():
    """Texts of long words that sums of their bytes' values can't tell apart."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    return [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}")]


def test_words_of_like_build_are_encoded_as_they_are(spark):
    rows = colliding()
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    got = {r.doc_id: r for r in bytebpe.encode_and_decode(documents(spark, rows).coalesce(1), RANKS, P.PATTERN).collect()}
    for i, t in rows:
        assert bytes(got[i].decoded).decode() == t
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t)
    check_pieces(packing.pack(documents(spark, rows).coalesce(1), WORD).collect(), rows)


def test_a_weak_hash_costs_no_exactness(monkeypatch):
    whole = kernels.range_hash
    monkeypatch.setattr(kernels, "range_hash", lambda *a: whole(*a) & np.uint64(0xFF))
    enc = wordbpe.WordBpe(WORD)
    all_ = ODD + [(t or "")[:4000] for _, t in texts()]
    for step in (1 << 19, 3000):
        got = []
        for lo, hi, raw, offs in kernels.row_ranges(pa.array(all_), step):
            ids, bounds = enc.encode(raw, offs)
            got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
        assert got == [x.ids for x in enc.tokenizer.encode_batch(all_, add_special_tokens=False)]
    raw, offs = kernels.text_buffer(pa.array(all_))
    w = kernels.words(raw, offs)
    where, back = kernels.distinct(raw, w.start, w.end)
    data = raw.tobytes()
    assert [data[s:e] for s, e in zip(w.start, w.end, strict=True)] == [data[w.start[where[k]] : w.end[where[k]]] for k in back]
    assert len(where) == len({data[s:e] for s, e in zip(w.start, w.end, strict=True)})


def test_long_texts_come_in_pieces(spark, library, monkeypatch):
    ranges = kernels.row_pieces
    monkeypatch.setattr(kernels, "row_pieces", lambda column, most=1 << 19: ranges(column, 500))
    all_ = ODD + [t or "" for _, t in texts()] + ["x y  z 'll it's " * 400, "日本 語" * 900, "a " * 2000 + "b" * 3000]
    counter = fst.PieceCounter(fst.MergeTable.load(MODEL))
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    word = wordbpe.WordBpe(WORD)
    got, ids, pre, n, pieces = [], [], [], 0, 0
    for lo, hi, raw, offs, more in kernels.row_pieces(pa.array(all_)):
        begun = bool(n)
        assert not begun or hi - lo == 1
        count = counter.count(raw, offs, begun)
        own, bounds = word.encode(raw, offs)
        start, end, first = bytebpe.pre_tokens(raw, offs, P.PATTERN)
        data = raw.tobytes()
        parts = [[data[s:e] for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] for i in range(hi - lo)]
        if begun:
            got[-1] += int(count[0])
            ids[-1] += own.tolist()
            pre[-1] += parts[0]
        else:
            got += count.tolist()
            ids += [own[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
            pre += parts
        n, pieces = more, pieces + more
    assert pieces > 10
    assert got == [len(library.encode(t)) for t in all_]
    assert ids == [x.ids for x in word.tokenizer.encode_batch(all_, add_special_tokens=False)]
    assert [[x for p in q for x in enc.encode_ordinary(p.decode())] for q in pre] == [enc.encode_ordinary(t) for t in all_]


def test_long_documents_round_trip(spark):
    rows = [(1, "lorem ipsum dolor " * 9000), (2, "short"), (3, "sit amet, " * 12000), (4, None)]
    cfg = bytebpe.BpeConfig(block_mb=1, step_kb=16)
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    got = {r.doc_id: r for r in bytebpe.encode_and_decode(documents(spark, rows).coalesce(1), RANKS, P.PATTERN, cfg).collect()}
    assert all(bytes(got[i].decoded).decode() == (t or "") and np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t or "") for i, t in rows)


def test_memory_of_a_long_text_is_a_small_multiple():
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from plexmill.llm import kernels as K, fst
import public_tokenizers as P
counter = fst.PieceCounter(fst.MergeTable.load(P.path("piece_bpe_32k.model")))
column = pa.array(["some words of a long text " * 2_500_000])
def peak(): return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
n = sum(int(counter.count(raw, offs, lo > 0 or k > 0).sum()) for k, (lo, hi, raw, offs, more) in enumerate(K.row_pieces(column)))
pieces = peak() - before
raw, offs = K.text_buffer(column)
w = K.words(K.lowered(raw), offs)
owner, h = K.shingles(w, 3)
print(pieces, peak() - before, len(raw) >> 20, n)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    pieces, whole, size, n = map(int, out)
    assert size > 60 and n > 10_000_000
    assert pieces < 100 and whole < 16 * size


def test_word_ids_like_the_library():
    enc = wordbpe.WordBpe(WORD)
    all_ = ODD + [t or "" for _, t in texts()]
    raw, offs = kernels.text_buffer(pa.array(all_))
    for _ in range(2):  # the second time from memory
        ids, bounds = enc.encode(raw, offs)
        for i, x in enumerate(enc.tokenizer.encode_batch(all_, add_special_tokens=False)):
            assert x.ids == ids[bounds[i] : bounds[i + 1]].tolist(), all_[i]


def check_pieces(got, rows):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(WORD)
    want = sorted(tuple(enc.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    by_doc, pad, total = {}, 0, 0
    for g in got:
        assert zlib.crc32(g.ids) >= 0 and len(g.ids) == 4 * g.length
        by_doc.setdefault((g.doc_id, g.doc_tokens), []).append(g)
    made = sum(g.length for g in got)
    assert made == sum(len(w) for w in want)
    unique = [i for i, _ in rows if i is not None and sum(i == j for j, _ in rows) == 1]
    for i in unique:
        parts = sorted((g for g in got if g.doc_id == i), key=lambda g: g.start)
        ids = np.concatenate([np.frombuffer(g.ids, "<u4") for g in parts]).tolist()
        assert [g.start for g in parts] == np.cumsum([0] + [g.length for g in parts])[:-1].tolist()
        assert tuple(ids) in want
    for q in {g.sequence_id for g in got}:
        at = 0
        for g in sorted((g for g in got if g.sequence_id == q), key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 2048
        total += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad <= total // 50


def test_packing_places_every_id_once(spark):
    rows = texts()
    got = packing.pack(documents(spark, rows).coalesce(1), WORD).collect()
    check_pieces(got, rows)
    assert packing.pack(documents(spark, []), WORD).collect() == []


def test_packing_in_small_pools_and_many_partitions(spark):
    rows = texts()
    check_pieces(packing.pack(documents(spark, rows).repartition(5), WORD, packing.PackConfig(pool_tokens=500)).collect(), rows)


def test_steps_hold_equal_tokens():
    p = packing.Packer(packing.PackConfig(step_tokens=4096))
    rows = [x for d, n in enumerate([5000, 300, 1700, 90, 2048, 1000, 600] * 20) for x in p.add(d, n)]
    rows += [*p.pack(), *p.finish()]
    per = {}
    for _, _, length, _, _, _, step in rows:
        per[step] = per.get(step, 0) + length
    assert sum(per.values()) == 20 * (5000 + 300 + 1700 + 90 + 2048 + 1000 + 600)
    assert max(per.values()) == 4096 and sum(v == 4096 for v in per.values()) >= 0.8 * len(per)
