"""Benchmark decontamination by pigeonhole edit matching.

A document holds a test item when some stretch of its normalised text (lower
case, runs of white space as one space) is within the error budget of the
normalised item: at most ``rate`` times the item's length insertions,
deletions and substitutions. An item is split into budget + 1 pieces; a
stretch within the budget holds one of them unchanged, so exact hits of the
pieces, found by one automaton over all pieces, give every candidate. A hit at
a known offset leaves a window of item length plus twice the budget. An edit
destroys at most three of an item's distinct trigrams; a window that lacks more
of them is passed over, in any other Myers' bit-parallel distance decides.

Items go out in blocks of bounded size (``BLOCK_CHARS``). A task matches each of
its documents against one block after another, with one automaton in memory at a
time, so that a document has one row however many blocks there are, and documents
aren't shuffled.

An item of fewer than ``SHORT`` characters is held only by a stretch that begins
and ends between words, so that "art" isn't found in "party". Scripts without
case may write no spaces; next to their letters every place counts as such.

Defined cases: null counts as empty; an empty item matches nothing; items that
repeat are matched under each of their ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
MIN_ITEM = 1
SHORT = 40
BLOCK_CHARS = 4 << 20


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 pieces, of even length."""
    parts = int(rate * len(item)) + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def trigrams(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


def between_words(text: str, at: int) -> bool:
    return not (0 < at < len(text) and all(c.isdecimal() or c.upper() != c for c in text[at - 1 : at + 1]))


def held_whole(item: str, text: str, low: int, high: int, budget: int) -> int | None:
    """The least edit distance, within the budget, of the item to a stretch of
    text[low:high] that begins and ends between words."""
    best = None
    for start in range(low, high):
        if not between_words(text, start):
            continue
        row = list(range(len(item) + 1))
        for end in range(start, min(high, start + len(item) + budget)):
            new = [row[0] + 1]
            for j, c in enumerate(item):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != text[end])))
            row = new
            if row[-1] <= (budget if best is None else best - 1) and between_words(text, end + 1):
                best = row[-1]
    return best


class Pattern:
    """Myers' bit-parallel approximate search for one item."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def least_distance(self, text: str) -> int:
        """The least edit distance of the item to any stretch of the text."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score, best, masks = full, 0, self.size, self.size, self.masks
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.rate, self.items = rate, [(i, t) for i, t in items if len(t) >= MIN_ITEM]
        self.patterns = [Pattern(t) for _, t in self.items]
        self.grams = [trigrams(t) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), tuple(where)))
        if found:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance found, position) of each item that the text holds."""
        if not self.items:
            return []
        hits: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                hits.setdefault(n, []).append(end + 1 - size - offset)
        out = []
        for n, begins in hits.items():
            item, whole = self.items[n]
            budget, size = int(self.rate * len(whole)), len(whole)
            begins.sort()
            at = 0
            while at < len(begins):  # hits that lie close share one window
                last = at
                while last + 1 < len(begins) and begins[last + 1] - begins[last] <= budget:
                    last += 1
                low, high = max(0, begins[at] - budget), begins[last] + size + budget
                window = text[low:high]
                at = last + 1
                if len(self.grams[n] - trigrams(window)) > 3 * budget:
                    continue
                distance = self.patterns[n].least_distance(window)
                if distance <= budget and size < SHORT:
                    distance = held_whole(whole, text, low, min(high, len(text)), budget)
                if distance is not None and distance <= budget:
                    out.append((item, distance, low))
                    break
        return sorted(out)


MATCHES = "doc_id long, item_ids array<long>, distances array<int>, positions array<int>"


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in lists of bounded size."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        text = normalised(row[1])
        block.append((row[0], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    yield block


class Blocks:
    """Blocks of items as broadcasts. A task holds the automaton of one block,
    built when it turns to that block; with a single block that is once."""

    def __init__(self, docs: DataFrame, items: DataFrame, item_id: str, item_text: str, rate: float, block_chars: int) -> None:
        context = docs.sparkSession.sparkContext
        order = lambda b: (b[0] is None, b[0] or 0, b[1])
        self.sent = [context.broadcast(pickle.dumps(sorted(b, key=order))) for b in item_blocks(items, item_id, item_text, block_chars)]
        self.rate = rate

    def matches(self, batches: Iterator[list[str | None]]) -> Iterator[list[list[tuple[int, int, int]]]]:
        """For each batch of texts, what each text holds of all blocks."""
        at, matcher = None, None
        for texts in batches:
            plain = [normalised(t) for t in texts]
            found: list[list[tuple[int, int, int]]] = [[] for _ in plain]
            turns = range(len(self.sent))
            for k in turns if at in (None, 0) else reversed(turns):  # begins with the block at hand
                if k != at:
                    at, matcher = k, Matcher(pickle.loads(self.sent[k].value), self.rate)
                for held, text in zip(found, plain, strict=True):
                    held += matcher.match(text)
            yield [sorted(f, key=lambda m: (m[0] is None, m)) for f in found]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document, matched or not: doc_id, item_ids, distances, positions."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = Blocks(docs, items, item_id, item_text, rate, block_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = []

        def texts() -> Iterator[list[str]]:
            for batch in batches:
                ids.append(batch["doc_id"].astype("Int64"))
                yield batch["text"].tolist()

        for rows in blocks.matches(texts()):
            yield pd.DataFrame({"doc_id": ids.pop(), "item_ids": [[r[0] for r in m] for m in rows], "distances": [[r[1] for r in m] for m in rows], "positions": [[r[2] for r in m] for m in rows]})

    return texts.mapInPandas(run, MATCHES)


def mark(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, n_items."""
    found = find_items(docs, items, **columns)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.size("item_ids").cast("long").alias("n_items"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns, unshuffled."""
    blocks = Blocks(docs, items, item_id, item_text, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def texts() -> Iterator[list[str]]:
            for batch in batches:
                held.append(batch)
                yield batch.column(batch.schema.get_field_index(text_col)).to_pylist()

        for rows in blocks.matches(texts()):
            yield held.pop().filter(pa.array([not m for m in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
