"""Benchmark items of fewer than 40 characters."""

from __future__ import annotations

from inspectra.llm import decontam

ITEMS = [(1, "Art"), (2, "what is the capital of france"), (3, "日本"), (4, ""), (5, "x")]
DOCS = [
    (1, "a party"), (2, "fine ART, they said"), (3, "Q: what is  the capital\nof France?"), (4, "what is the kapital of frence"), (5, "what was a kapytal in frenze"),
    (6, "somewhat is the capital of francesca"), (7, "昔日本語"), (8, None), (9, "box"), (10, "art"), (11, "x y"), (12, "wha is the capital of francex"),
]


def test_short_items_are_found_between_words(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {1: [], 2: [1], 3: [2], 4: [2], 5: [], 6: [], 7: [3], 8: [], 9: [], 10: [1], 11: [5], 12: [2]}
    assert {r.doc_id: list(r.item_ids) for r in decontam.mark(docs, items).collect()} == want
    assert {r.doc_id for r in decontam.keep_clean(docs, items).collect()} == {i for i, found in want.items() if not found}
