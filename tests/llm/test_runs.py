"""Periodic runs against brute force, and the query over odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from inspectra.llm import queries, runs

R = random.Random(11)


def brute(words):
    """(start, length, period) of all runs, by comparing words q apart."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def periodic(n, kinds):
    words = [f"w{R.randrange(kinds)}" for _ in range(n)]
    a = R.randrange(n)
    p = 1 + (n - a) // R.randrange(3, 9)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def several():
    for kinds in (1, 2, 3, 5, 50):
        for _ in range(60):
            n = R.randrange(1, 140)
            yield [f"w{R.randrange(kinds)}" for _ in range(n)]
            yield periodic(n, kinds)
    yield []


@pytest.mark.parametrize("together", [1, 7, 1000])
def test_runs_equal_brute_force(together):
    texts = list(several())
    for at in range(0, len(texts), together):
        split = [[w.encode() for w in t] for t in texts[at : at + together]]
        found, left = runs.collapse_words(split)
        for words, got, text in zip(texts[at : at + together], found, left, strict=True):
            want = brute(words)
            assert [tuple(map(int, r)) for r in got] == want
            assert text.decode().split() == kept(words, want)


def test_many_words_and_hashes_that_lie(monkeypatch):
    thue = [b"a"]
    for _ in range(9):
        thue += [b"b" if w == b"a" else b"a" for w in thue]
    assert [tuple(map(int, r)) for r in runs.collapse_words([thue * 5])[0][0]] == [(0, 5 * 512, 512)]
    assert [tuple(map(int, r)) for r in runs.collapse_words([[b"a"] * 300_000])[0][0]] == [(0, 300_000, 1)]
    honest, calls = runs.Hashes.same, []

    def lies(self, a, b, size):
        calls.append(1)
        return np.ones(len(a), dtype=bool) if len(calls) < 40 else honest(self, a, b, size)

    monkeypatch.setattr(runs.Hashes, "same", lies)
    words = periodic(200, 2)
    assert [tuple(map(int, r)) for r in runs.collapse_words([[w.encode() for w in words]])[0][0]] == brute(words)


def test_pairs_are_replaced_most_frequent_first():
    ids = np.array([1, 2, 1, 2, 1, 2, 2, 1])
    left, boundary, right, kind = next(runs.grammar(ids, np.zeros(8, dtype=int)))
    assert (left.tolist(), boundary.tolist(), right.tolist(), kind.tolist()) == ([0, 2, 4, 6], [1, 3, 5, 7], [2, 4, 6, 8], [0, 0, 0, 1])
    assert runs.most_frequent_first(np.array([0, 1, 2, 4]), np.array([5, 5, 5, 1])).tolist() == [0, 2, 4]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_on_odd_rows(spark, tmp_path):
    texts = [None, "", " \n\t", "one", "a " * 6, "\x0ba b\r" * 9, "naïve\u00a0x y " * 4, "long words here " * 1_000, *[" ".join(t) for t in list(several())[:150]]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, "a " * 6), (None, "x " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS runs", "1 AS n_words", "2 AS _words", "3 AS start")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, (text or "").encode().split()) if doc_id is not None else text.encode().split()
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, found))).hexdigest()))
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_runs(spark, f"{tmp_path}/none").count() == 0
