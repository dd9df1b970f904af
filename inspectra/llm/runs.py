"""Periodic runs of words, found in a grammar, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of at least max(6, 4 q) words, which no neighbouring word
extends. Of each run the words after its first q are repeats; a text is
collapsed by dropping every word that is a repeat in any run.

1. Re-Pair: the word ids of some hundred thousand words of text become a
   grammar. In each round pairs of symbols that occur more than once are
   replaced, the most frequent first; pairs don't cross texts. When no pair
   repeats, neighbours are paired until a text is one symbol.
2. Each nonterminal is looked at once, at one of its places: a run that lies in
   it and crosses its boundary has two periods on one side of it, so the
   candidates are the squares that end or begin there. Only the smallest
   candidate is extended; larger ones that it covers are its multiples.
3. The runs of a nonterminal are carried to all places where it was made, and
   what overlaps by a period or more is one run. The lowest nonterminal that
   holds a run finds it whole; parts that others found are merged into it.

Equal stretches are compared by hashes; every run is checked word by word at
the end, and should the hashes have lied, other bases are taken.

Defined cases: null has no words; a text without runs is its words joined by
single spaces; repeated rows each give a row; a null id passes; an empty table
gives an empty result; other columns are ignored. A text is read whole at any
length; it is one task's work, in about 300 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6
TIMES = 4
CHUNK_WORDS = 250_000
CANDIDATES = 1 << 20
#: Two primes below 2^31.
PRIMES = (2147483647, 2147483629)


class Hashes:
    """Compares stretches of a sequence by two polynomials."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for p in PRIMES:
            base = int(rng.integers(1 << 20, p - 1))
            power = np.ones(len(ids) + 1, dtype=np.int64)
            done, step = 1, base
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % p
                step, done = step * step % p, done + more
            value = (ids + 1) % p * int(rng.integers(1 << 20, p - 1)) % p
            self.sums.append(np.concatenate(([0], np.cumsum(value * power[:-1] % p))))
            self.powers.append(power)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` ids from a on equal those from b on; a <= b."""
        out = np.ones(len(a), dtype=bool)
        for p, s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            out &= (s[a + size] - s[a]) % p * power[b - a] % p == (s[b + size] - s[b]) % p
        return out

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many ids, ``limit`` at most, agree from a and b on (step 1) or
        before a and b (step -1); a <= b."""
        low, high = np.zeros(len(a), dtype=np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if step < 0 else 0
            good = self.same(a - back, b - back, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def spread_out(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of given sizes: of each member its group, and its place in it."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def most_frequent_first(idx: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of pairs that can be replaced together: in order of rank, and from
    left to right in a stretch of one pair. idx: ascending places."""
    taken = []
    while len(idx):
        touch = np.diff(idx) == 1
        new = np.append(True, ~(touch & (rank[1:] == rank[:-1])))
        begins = np.flatnonzero(new)
        first = rank[begins]
        touching = touch[begins[1:] - 1]
        best = np.ones(len(begins), dtype=bool)
        best[1:] &= ~(touching & (first[1:] < first[:-1]))
        best[:-1] &= ~(touching & (first[:-1] < first[1:]))
        stretch = np.cumsum(new) - 1
        take = best[stretch] & ((np.arange(len(idx)) - begins[stretch]) % 2 == 0)
        taken.append(idx[take])
        gone = take.copy()
        gone[1:] |= touch & take[:-1]
        gone[:-1] |= touch & take[1:]
        idx, rank = idx[~gone], rank[~gone]
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, dtype=np.int64)


def grammar(ids: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of Re-Pair. Of each round, for every place where a nonterminal is
    made: its left end, its boundary, its right end, and which of the round's
    nonterminals it is."""
    symbol, at, fresh = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), dtype=bool)
    following = int(symbol.max()) + 1 if len(symbol) else 0
    repeats = True
    while True:
        text = text_of[at]
        joins = text[1:] == text[:-1]
        if not joins.any():
            return
        if repeats:
            # a pair that was there before and isn't fresh occurs once
            idx = np.flatnonzero(joins & (fresh[1:] | fresh[:-1]))
            code, _ = pd.factorize(symbol[idx] * following + symbol[idx + 1])
            count = np.bincount(code)
            order = np.lexsort((np.arange(len(count)), -count))
            rank = np.empty(len(count), dtype=np.int64)
            rank[order] = np.arange(len(count))[::-1]
            often = count[code] > 1
            taken = most_frequent_first(idx[often], rank[code[often]])
            repeats = len(taken) > 0
            if repeats:
                kind = pd.factorize(code[np.searchsorted(idx, taken)])[0]
        if not repeats:
            _, place = spread_out(np.bincount(np.cumsum(np.append(True, ~joins)) - 1))
            taken = np.flatnonzero(joins & (place[:-1] % 2 == 0))
            kind = np.arange(len(taken))
        end = np.append(at[1:], len(ids))
        yield at[taken], at[taken + 1], end[taken + 1], kind
        symbol[taken] = following + kind
        following += int(kind.max()) + 1
        fresh = np.zeros(len(symbol), dtype=bool)
        fresh[taken] = True
        stay = np.ones(len(symbol), dtype=bool)
        stay[taken + 1] = False
        symbol, at, fresh = symbol[stay], at[stay], fresh[stay]


def squares(ids: np.ndarray, known: Hashes, low: np.ndarray, middle: np.ndarray, high: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, q), ordered: two equal stretches of q words begin (right) or end at the
    node's boundary, and the node has room for a run of period q."""
    most = np.minimum((high - middle if right else middle - low) // 2, (high - low) // TIMES)
    nodes, periods = [], []
    for some in np.array_split(np.arange(len(most)), max(1, int(most.sum()) // CANDIDATES)):
        node, q = spread_out(most[some])
        node, q = some[node], q + 1
        for k in range(2):  # most end at the first word or the second
            place = middle[node] + k if right else middle[node] - 1 - k
            good = (ids[place] == ids[np.minimum(place + q, len(ids) - 1) if right else place - q]) | (q <= k)
            node, q = node[good], q[good]
        begin = middle[node] if right else middle[node] - 2 * q
        good = known.same(begin, begin + q, q)
        nodes.append(node[good])
        periods.append(q[good])
    return np.concatenate(nodes), np.concatenate(periods)


def crossing(ids: np.ndarray, known: Hashes, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """node, start, end, period of the runs in each node that cross its boundary."""
    found = []
    for right in (True, False):
        node, q = squares(ids, known, low, middle, high, right)
        while len(node):
            first = np.append(True, node[1:] != node[:-1])
            n, p = node[first], q[first]
            m = middle[n]
            a = m if right else m - p
            start = a - known.common(a, a + p, a - low[n], -1)
            end = a + p + known.common(a, a + p, high[n] - a - p, 1)
            good = (start < m) & (end > m) & (end - start >= np.maximum(LEAST, TIMES * p))
            found.append((n[good], start[good], end[good], p[good]))
            reach = end - m if right else m - start
            rest = ~first & (2 * q > reach[np.cumsum(first) - 1])
            node, q = node[rest], q[rest]
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    node, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by the period or more become one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    lift = np.cumsum(np.append(0, period[1:] != period[:-1])) * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + lift) - lift
    new = np.append(True, (period[1:] != period[:-1]) | (start[1:] > so_far[:-1] - period[1:]))
    begins = np.flatnonzero(new)
    return start[begins], np.maximum.reduceat(end, begins), period[begins]


def are_periodic(ids: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether all words of the stretches are as their hashes say."""
    sizes = end - start - period
    for some in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum()) // CANDIDATES)):
        run, k = spread_out(sizes[some])
        place = start[some][run] + k
        if (ids[place] != ids[place + period[some][run]]).any():
            return False
    return True


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """text, start (within the text), length, period of all runs of texts that
    stand one after another; by text, start and period."""
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    for seed in range(1 << 30):
        known, parts = Hashes(ids, seed), []
        for left, boundary, right, kind in grammar(ids, text_of):
            one = np.zeros(int(kind.max()) + 1, dtype=np.int64)
            one[kind[::-1]] = np.arange(len(kind))[::-1]
            one = one[right[one] - left[one] >= LEAST]
            node, start, end, period = crossing(ids, known, left[one], boundary[one], right[one])
            if not len(node):
                continue
            # carry the runs of a nonterminal to its places
            of, base = kind[one][node], left[one][node]
            order = np.argsort(of, kind="stable")
            of, start, end, period = of[order], (start - base)[order], (end - base)[order], period[order]
            first, many = np.searchsorted(of, kind), np.searchsorted(of, kind, "right")
            place, k = spread_out(many - first)
            pick = first[place] + k
            parts.append((left[place] + start[pick], left[place] + end[pick], period[pick]))
        start, end, period = merged(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, dtype=np.int64),) * 3
        if are_periodic(ids, start, end, period):
            break
    text = text_of[start]
    out = pd.DataFrame({"text": text, "start": start - begins[text], "length": end - start, "period": period})
    return out.sort_values(["text", "start", "period"], ignore_index=True)


def collapse_words(split: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text its runs (start, length, period) and its kept words, joined."""
    sizes = np.array([len(s) for s in split])
    words = [w for s in split for w in s]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = find_runs(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)), sizes)
    begins = np.cumsum(sizes) - sizes
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = begins[found["text"].to_numpy()] + found["start"].to_numpy()
    np.add.at(change, at + found["period"].to_numpy(), 1)
    np.add.at(change, at + found["length"].to_numpy(), -1)
    for text, *run in found.itertuples(index=False):
        runs[text].append(tuple(run))
    keep = (np.cumsum(change[:-1]) == 0).tolist()
    return runs, [
        b" ".join([w for w, k in zip(s, keep[b : b + len(s)], strict=True) if k] if r else s) for s, r, b in zip(split, runs, begins.tolist(), strict=True)
    ]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs by start and period,
    collapsed_text. Nothing is shuffled."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            split, begin, size = [], 0, 0
            for k, text in enumerate(batch["text"]):
                split.append(text.encode().split())
                size += len(split[-1])
                if size >= CHUNK_WORDS or k == len(batch) - 1:
                    runs, kept = collapse_words(split)
                    yield pd.DataFrame({
                        "doc_id": ids.iloc[begin : k + 1].array, "n_words": [len(s) for s in split],
                        "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], "collapsed_text": [t.decode() for t in kept],
                    })
                    split, begin, size = [], k + 1, 0

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(task, RUNS)
