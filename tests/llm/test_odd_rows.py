"""Cases that lost or doubled rows: further fields, long texts, several blocks, repeated rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm import chat, common, decontam, exact_dedup, quality, simhash

RECORDS = [
    '{"conv_id": 1, "messages": []}', '{"conv_id": 2, "id": "x", "messages": [{"role": "user", "content": "hi", "name": "bob"}]}',
    '{"conv_id": 3, "meta": {"a": {"b": 1}, "c": [1, 2], "role": "x"}, "prompt": "p", "response": "r", "z": null}',
    '{"conv_id": 4, "turn": 0, "role": "user", "text": "x", "tags": ["a"], "m": [{"k": 1, "text": "no"}]}', '{"conv_id": 5, "unknown": 1}', '{"conv_id": 6, "messages": [], "id": 3}',
]


def test_further_fields_and_empty_lists(spark):
    df = spark.createDataFrame([(r,) for r in RECORDS], "record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [(2, 0, "user", "hi"), (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", "x")]
    assert [r.example for r in chat.unknown_layouts(df).collect()] == [RECORDS[4]]


def test_table_rows_with_odd_values(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "b"), (2, None, "tool", ""), (2, None, "user", "c"), (2, None, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"content": F.lit("clash"), "segment": F.lit(1)})
    df = df.unionByName(spark.range(1).select(F.lit(9).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), 25_000_000).alias("text"), F.lit("clash").alias("content"), F.lit(1).alias("segment")))
    out = {r.conv_id: r for r in chat.digest_conversations(chat.read_segments(chat.format_turns(chat.table_turns(df)))).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, None: 1, 2: 3, 9: 1} and out[9].loss_chars == 25_000_000
    with pytest.raises(ValueError):
        chat.table_turns(df.drop("role"))


def test_one_row_per_document_over_several_blocks(spark):
    items = [(k, " ".join(f"{chr(97 + k)}{j * k}{chr(98 + k)}" for j in range(12))) for k in range(12)] + [(3, "item number 3 again, with an id that is there already, yes")]
    docs = [(1, "x " + items[1][1] + " y " + items[11][1]), (2, "nothing"), (3, None), (4, items[12][1]), (4, items[12][1]), (5, "long " * 50_000 + items[6][1] + " tail" * 50_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "key long, body string")
    want = Counter({(1, (1, 11)): 1, (2, ()): 1, (3, ()): 1, (4, (3,)): 2, (5, (6,)): 1})
    for chars in (1, 150, 10_000):
        got = decontam.mark(d, b, item_id="key", item_text="body", block_chars=chars)
        assert Counter((r.doc_id, tuple(r.item_ids)) for r in got.collect()) == want
    assert sorted(r.doc_id for r in decontam.keep_clean(d, b, item_id="key", item_text="body", block_chars=150).collect()) == [2, 3]


@pytest.mark.parametrize("small", [True, False])
def test_rows_that_stay(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = [(1, "a b"), (1, "a b"), (1, "ab "), (2, "ab"), (None, "q"), (None, "q"), (3, None), (4, ""), (5, "solo")] + [(9, "hot text")] * 60 + [(k, "hot text") for k in range(20, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(c) for c in ("digest", "kept", "row", "first", "_again")})
    for counters in (1, 1024):
        kept = exact_dedup.keep_first(d, counters=counters)
        assert kept.columns == d.columns
        assert Counter((r.doc_id, "".join((r.text or "").split())) for r in kept.collect()) == Counter([(1, "ab"), (None, "q"), (3, ""), (5, "solo"), (9, "hottext")])
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and kept.count() == simhash.group(d).select("component_id", "first").distinct().count()


def test_both_views_hand_labels_over():
    """Two informative views, each blind where the other sees."""
    rng = np.random.default_rng(3)
    y = (rng.random(1200) < 0.6).astype(float)
    sees = rng.random(1200) < 0.5
    views = [np.column_stack([np.where(s, 2 * y - 1, 0) + rng.normal(0, 0.1, 1200), rng.normal(size=1200)]) for s in (sees, ~sees)]
    model = quality.co_train(tuple(v[:300] for v in views), y[:300], tuple(v[300:] for v in views), handed=60, sure=0.9)
    assert sum(model.handed[0::2]) > 50 and sum(model.handed[1::2]) > 50
    assert ((model.score(*views)[300:] > 0.5) == (y[300:] == 1)).mean() > 0.95


def test_a_length_that_is_text(spark):
    d = spark.createDataFrame([(k, f"word {k} " * 5, "en", None, str(k)) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(40)], "doc_id long, quality long")
    assert quality.keep_good(d, labels).columns == d.columns
