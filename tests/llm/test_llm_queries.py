"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import pytest

from inspectra.llm import decontam, queries
from inspectra.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(name, same_as_sql):
    assert same_as_sql(queries.QUERIES[name], queries.SQL[name]) > 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    items = [(r.item_id, decontam.normalised(r.text)) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name != "BPE encoding":
            assert docs.columns == columns
        if name == "quality classifier":
            gone = [labels[i] for i in ids - now if i in labels]
            assert gone.count(0) >= 0.9 * list(labels.values()).count(0) and gone.count(1) <= 2
        if name == "exact deduplication":
            assert max(Counter("".join((r.text or "").split()) for r in docs.collect()).values()) == 1
        if name == "benchmark decontamination":
            held = {r.doc_id for r in before.collect() if any(t in decontam.normalised(r.text) for _, t in items)}
            assert held.isdisjoint(now)
        ids = now
    assert corpus_pipeline.run(spark, SF).count() == len(ids)
