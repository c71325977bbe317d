"""The pipeline's stages in order, on the smallest tables."""

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark):
    import corpus_pipeline as c
    from lexigauge.llm.common import read, staged

    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, folder, "labels").collect()}
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    left = set(words)
    for name, stage in c.STAGES[:-1]:
        out = staged(stage(spark, docs, folder), name)
        assert out.columns == c.COLUMNS
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= left
        gone = left - set(ids)
        if name in ("quality_rules", "quality_classifier"):
            good = [i for i in left if labels.get(i) == 1 and words[i] >= 50]
            assert sum(i in gone for i in good) <= 0.02 * len(good)
        left, docs = set(ids), out
    assert not [i for i in left if labels.get(i) == 0]
    assert {r.doc_id for r in c.STAGES[-1][1](spark, docs, folder).collect()} == left
