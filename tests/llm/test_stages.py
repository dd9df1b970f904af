"""Pipeline stages on their own: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inspectra.llm.common import stored, table

SF = "/root/testdata/sf0.001"
CLASHING = ["digest", "kept", "row", "first", "node", "root", "shingle", "item_id", "ids", "decoded", "text_hash", "score", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    """The test table, and odd rows; a benchmark item stands late in a long text."""
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [
        (None, None, None, None, None), (90001, None, None, None, None), (90002, "", "", "", 0), (90003, " \n\t ", "en", "web", 4),
        (90004, "a short text that stands here twice over", "en", "web", 40), (90004, "a short text that stands here twice over", "en", "web", 40),
        (90005, " ".join(f"w{k}" for k in range(60_000)) + " " + item + " end", "en", "web", 400_000), (90006, "x" * 200_000, None, "web", -1),
    ]
    docs = table(spark, SF, "documents")
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return stored(both.repartition(3).withColumns({c: F.lit("clash") for c in CLASHING}), "odd")


def whole(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def blank(rows: Counter) -> int:
    return sum(n for r, n in rows.items() if not (r[1] or "").strip())


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, odd, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    given, out = whole(odd), stored(stage(spark, odd, SF), "stage")
    if name == "BPE encoding":
        tokens = [(r.doc_id, r.n_tokens) for r in out.collect()]
        assert Counter(i for i, _ in tokens) == Counter(r[0] for r in given.elements())
        assert {n for i, n in tokens if i in (None, 90001, 90002)} == {0} and dict(tokens)[90005] > 60_000
        return
    assert out.columns == odd.columns
    got = whole(out)
    assert got <= given
    ids = Counter(r[0] for r in got.elements())
    if name == "quality classifier":
        assert all(got[r] in (0, n) for r, n in given.items())
    elif name == "benchmark decontamination":
        assert ids[90005] == 0 and ids[90004] == 2 and blank(got) == blank(given) and ids[90006] == 1
    else:
        assert ids[90004] == 1 and blank(got) == 1 and ids[90005] == ids[90006] == 1


@pytest.mark.parametrize("k", range(5))
def test_stage_on_an_empty_table(spark, odd, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    out = stored(stage(spark, stored(odd.limit(0), "empty"), SF), "stage")
    assert out.count() == 0 and (name == "BPE encoding" or out.columns == odd.columns)
