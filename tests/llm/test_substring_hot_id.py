"""Substring deduplication where one id has many different texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from inspectra.llm import substring
from tests.llm.test_operators import brute_windows


@pytest.mark.parametrize("held", [0, substring.HELD_BYTES])
@pytest.mark.parametrize("small", [True, False])
def test_rows_of_one_id_lose_their_own_words(spark, small, held, monkeypatch):
    monkeypatch.setattr(substring, "HELD_BYTES", held)
    monkeypatch.setattr(substring, "TASK_ANCHORS", 500)
    if not small:
        monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(70)] for _ in range(6)]
    rows = [(k, " ".join([*(word() for _ in range(rng.randrange(30))), *rng.choice(passages), *(word() for _ in range(9))])) for k in range(12)]
    rows += [(7, " ".join([*(word() for _ in range(rng.randrange(90))), *rng.choice(passages)[rng.randrange(30):], *(word() for _ in range(rng.randrange(40)))])) for _ in range(150)]
    rows += [rows[20], rows[20], (None, rows[20][1]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicate(docs).collect()]
    assert Counter(got) == Counter(brute_windows(rows))
    assert sum(r[2] > 0 for r in got) > 40


def test_joined_intervals_by_key():
    rng = np.random.default_rng(2)
    keys = np.stack([rng.integers(-2, 2, 400) << 62, rng.integers(0, 3, 400)], axis=1)
    begin = rng.integers(-20, 2000, 400)
    end = np.maximum(begin, 0) + rng.integers(1, 12, 400)
    names, spans = substring.merged_by_key(keys, begin, end)
    assert [tuple(n) for n in names.tolist()] == sorted({tuple(k) for k in keys.tolist()})
    for name, packed in zip(names, spans, strict=True):
        own = (keys == name).all(axis=1)
        want = {p for a, b in zip(begin[own], end[own], strict=True) for p in range(max(0, a), b)}
        pairs = substring.unpacked(packed).tolist()
        assert {p for a, b in pairs for p in range(a, b)} == want
        assert all(b < c for (_, b), (c, _) in zip(pairs, pairs[1:], strict=False))


def test_rows_between_steps_do_not_grow_with_tasks(spark, monkeypatch):
    """Intervals leave a task by document and zone: as many rows with 40 tasks as with 2, and far fewer than windows."""
    monkeypatch.setattr(substring, "TASK_ANCHORS", 1)
    rng = random.Random(5)
    passages = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(3)]
    rows = [(k, " ".join([f"d{k}", *passages[k % 3]])) for k in range(24)]
    docs = substring.with_marks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").repartition(24, "doc_id")
    spans = np.array([[0, 500]], dtype="<i4").tobytes()
    kinds = "high long, low long, doc_id long, mark long, place int, run int, kind byte"
    windows = substring.stored(docs.selectExpr("*", f"unhex('{spans.hex()}') spans").mapInPandas(substring.find_windows, kinds), "windows")
    monkeypatch.setattr(substring, "TASK_ANCHORS", 1_000_000)
    made = []
    for tasks in ("2", "40"):
        with_conf = {"spark.sql.shuffle.partitions": tasks, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        before = {k: spark.conf.get(k) for k in with_conf}
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        made.append(substring.joined_by_zone(substring.beaten(windows), ["doc_id", "mark"]).count())
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made[0] == made[1] and 21 <= made[0] < 21 * 351 / 8
