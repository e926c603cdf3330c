import zlib

import corpus_pipeline

from plexmill.llm import queries, toxicity
from plexmill.llm.storage import Workspace

from .test_dedup import brute
from .test_text_rules import plain_quality, plain_toxicity
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_act_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, before = Workspace(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = work.save(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        assert after.exceptAll(before).isEmpty()
        before = after
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries.QUERIES if n != "pipeline"]
    assert names == [f"op{k}" for k in range(1, 14)]


def test_stages_agree_with_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work = Workspace(spark, "t")
    cfg = toxicity.ToxicityConfig()
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = [(labels[i], t or "") for i, t, _ in rows if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    scores = plain_toxicity(learnt, [t or "" for _, t, _ in rows], cfg)
    after = work.save(stages["toxicity"](spark, docs, SF), "a")
    assert kept(after) == {i for (i, _, _), s in zip(rows, scores, strict=True) if s < cfg.threshold}

    rows = [(r.doc_id, r.text, r.lang) for r in after.collect()]
    good = plain_quality([(t, lang) for _, t, lang in rows])
    after = work.save(stages["quality_rules"](spark, after, SF), "b")
    assert kept(after) == {i for (i, _, _), (_, k) in zip(rows, good, strict=True) if k}

    rows = [(r.doc_id, r.text) for r in after.collect()]
    after = work.save(stages["near_dedup"](spark, after, SF), "c")
    assert kept(after) == {i for i, _, component in brute(rows, 5, 80) if i == component}

    rows = [(r.doc_id, r.text) for r in after.collect()]
    check_pieces(stages["packing"](spark, after, SF).collect(), rows)
