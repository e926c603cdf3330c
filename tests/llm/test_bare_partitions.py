"""Input partitions that hold only null or empty texts, alone and between partitions of prose."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from plexmill.llm import bytebpe, fst, licenses, minhash, packing, quality, sharding, toxicity, weaklabel

from .helpers import documents, prose

MODEL, RANKS, WORD = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
NULL, EMPTY = [(1, None), (2, None)], [(3, ""), (4, "")]
BOTH = [(5, None), (6, "")]
PROSE = [(7, prose(1, 80)), (8, prose(2, 90))]
LAYOUTS = [[NULL], [EMPTY], [BOTH], [PROSE, NULL, PROSE, EMPTY, PROSE, BOTH]]


def parted(spark, layout):
    """A partition for each list of rows."""
    out = None
    for rows in layout:
        part = documents(spark, rows).coalesce(1)
        out = part if out is None else out.union(part)
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
def test_byte_bpe_equals_the_library(spark, layout):
    enc = bytebpe._encoding(RANKS, P.PATTERN)
    got = bytebpe.digest(bytebpe.encode_and_decode(parted(spark, layout), RANKS, P.PATTERN)).collect()
    want = []
    for i, t in (row for rows in layout for row in rows):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_no_operator_fails(spark, layout):
    docs = parted(spark, layout).cache()
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    ids = sorted(i for rows in layout for i, _ in rows)
    for out in (
        minhash.near_duplicates(docs), sharding.digest(sharding.shard(docs)), quality.judge(docs), toxicity.score_toxicity(docs, labels),
        fst.token_counts(docs, MODEL), weaklabel.classify(docs), licenses.scan_licenses(docs),
    ):
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == ids
    assert {r.doc_id for r in packing.pack(docs, WORD).select("doc_id").collect()} == set(ids)
    docs.unpersist()
