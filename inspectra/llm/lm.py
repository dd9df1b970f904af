"""LM scoring: a causal self-attention model on subword ids, trained in numpy.

One pass over the documents turns each text into subword ids, which are written
as a table, and counts words and ids over all training documents. Ids are
numbered by falling count: each of the first 992 is a unit of its own, the rest
are dealt to 32 further units. Two passes over the ids of all training documents
count pairs of neighbouring units, and what follows the ``PAIRS`` most frequent
pairs; a context is such a pair, or else the last unit. Units that follow the
same units are gathered in ``GROUPS`` groups.

An id's probability is that of its group, times that of its unit in the group
given the context (from the counts, discounted), times its share of the unit's
count. The group's is what the model learns: an embedding of every id and of its
place, one causal self-attention layer and a tanh layer correct what the counts
say of it. (Key and value projections are left to the matrices that they would
be multiplied with.) Adam trains it on every window of all training documents,
each of which is in one of ``ROUNDS`` rounds. A task is a trainer and reads
about ``TRAINER_IDS`` ids, so that trainers grow with the corpus; after a round
their weights are averaged in Spark.

A document is scored in windows of 32 ids that overlap by 6, in batches with a
causal mask; every id is scored once, in the first window it is in unless that
is its start. The unigram base score looks frequent words up in a table of
bounded size; the others go through a join with the counts.

Defined cases: null counts as empty; an empty text has its end token only; a
null id is taken as the empty string for the held-out rule; repeated rows each
count and get a row; without training documents the counts are all zero; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.llm.common import stored

UNITS, SHARED = 1024, 32
OWN = UNITS - SHARED
GROUPS, PAIRS = 32, 3072
DIRECTIONS, GROUPING_STEPS = 24, 15
DISCOUNT = 0.75
WIDTH = 16
WINDOW, OVERLAP = 32, 6
STRIDE = WINDOW - OVERLAP
ROUNDS, TRAINER_IDS = 2, 8_000_000
BATCH, RATE = 128, 8e-3
FREQUENT, FREQUENT_BYTES = 150_000, 64
BLOCK = 64
KNOWN_WORDS = 300_000
COUNTED_IDS = 1 << 25
#: Numbers of a weight array that go into one row when trainers are averaged.
PIECE = 4096


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Subwords:
    """Ids by the ranks of a byte-level vocabulary; a word stands with a space
    before it. The end id comes after the last rank. As words hold no space, a
    word's first id and no other begins with one."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begins = np.zeros(self.size + 1, dtype=bool)
        self.begins[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.begins[self.size] = True
        self.dtype = np.dtype("<u2" if self.size < 1 << 16 else "<u4")

    def of(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode())

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, and how many each has. The tokenizer
        gets the words as one string, which it cuts at each space, unless some
        hold white space beyond ASCII's."""
        joined = b" ".join(words).decode()
        if joined and joined.split() == joined.split(" "):
            ids = np.array(self.encode(" " + joined), dtype=np.int32)
            return ids, np.diff(np.append(np.flatnonzero(self.begins.take(ids)), len(ids)))
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for alone, run in groupby(words, key=lambda w: w.decode().split() != [w.decode()]):
            part = list(run)
            if alone:
                each = [self.of(w) for w in part]
                ids.append(np.array([i for e in each for i in e], dtype=np.int32))
                sizes.append(np.array([len(e) for e in each], dtype=np.int64))
            else:
                more, n = self.spell(part)
                ids.append(more)
                sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Of ids laid end to end: each word's ids as bytes, and where it begins."""
        begins = np.flatnonzero(self.begins.take(ids))
        raw, cuts = ids.astype(self.dtype).tobytes(), (begins * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], begins

    def word(self, key: bytes) -> str:
        return b"".join([self.bytes_of[i] for i in np.frombuffer(key, self.dtype).tolist()])[1:].decode()


_subwords: dict[str, Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path, pattern)
    return _subwords[path]


@dataclass
class Laid:
    """ids and sizes of documents laid end to end, each closed by the end id;
    of each word its position in the lexicon."""

    ids: np.ndarray
    sizes: np.ndarray
    words: np.ndarray


class Lexicon:
    """Ids of words and how often they were counted, in arrays."""

    def __init__(self, encode: Subwords) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.number, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        while at + len(values) > len(array):
            array = np.concatenate((array, np.zeros_like(array)))
        array[at : at + len(values)] = values
        setattr(self, name, array)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Positions of words in the arrays."""
        found = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            ids, sizes = self.encode.spell(new)
            at = len(self.index)
            self._put("begin", at, np.cumsum(sizes) - sizes + self.used)
            self._put("number", at, sizes)
            self._put("count", at, np.zeros(len(new), np.int64))
            self._put("ids", self.used, ids)
            self.used += len(ids)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            found[missing] = np.fromiter(map(self.index.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        return found

    def lay_out(self, docs: list[list[bytes]]) -> Laid:
        per_doc = np.array([len(d) for d in docs], dtype=np.int64)
        found = self.find([w for d in docs for w in d])
        number = self.number.take(found)
        doc = np.repeat(np.arange(len(docs)), per_doc)
        sizes = np.bincount(doc, number, minlength=len(docs)).astype(np.int64) + 1
        count = np.arange(number.sum())
        ids = np.full(int(sizes.sum()), self.encode.size, np.int32)
        ids[count + np.repeat(doc, number)] = self.ids.take(count + np.repeat(self.begin.take(found) - (np.cumsum(number) - number), number))
        return Laid(ids, sizes, found)

    def counted(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words with a count, their counts, and the count of each id."""
        at = np.flatnonzero(self.count[: len(self.index)])
        words = list(self.index)
        n = len(self.index)
        ids = np.bincount(self.ids[: self.used], np.repeat(self.count[:n], self.number[:n]), minlength=self.encode.size + 1)
        return [words[i].decode() for i in at.tolist()], self.count[at], ids.astype(np.int64)


def slots_by_count(counts: np.ndarray) -> np.ndarray:
    """Slots by falling count: below ``OWN`` they are units, from ``UNITS`` on
    they go to the last units in turn."""
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
    return np.where(rank < OWN, rank, rank - OWN + UNITS).astype(np.int32)


def unit_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id, its unit and the logarithm of its share of the unit's count."""
    slots, smooth = slots_by_count(counts), counts + 0.1
    unit = np.where(slots < UNITS, slots, OWN + slots % SHARED)
    return unit, np.log(smooth / np.bincount(unit, smooth, minlength=UNITS)[unit])


def discounted(counts: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities of rows of counts; what the discount takes goes to ``back``."""
    n, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    p = np.maximum(counts.astype(np.float32) - np.float32(DISCOUNT), 0) / np.maximum(n, 1).astype(np.float32)
    p += np.where(n > 0, DISCOUNT * kinds / np.maximum(n, 1), 1).astype(np.float32) * back
    return p


def frequent_pairs(pairs: np.ndarray) -> np.ndarray:
    return np.argsort(-pairs.ravel(), kind="stable")[:PAIRS]


def groups_of(pairs: np.ndarray) -> np.ndarray:
    """A group for each unit, by what comes before it: spherical k-means on the
    main directions of the positive mutual information of pairs."""
    joint = (pairs + 0.1) / (pairs + 0.1).sum()
    above = np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))).clip(0)
    _, size, directions = np.linalg.svd(above, full_matrices=False)
    x = directions[:DIRECTIONS].T * np.sqrt(size[:DIRECTIONS])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    often = pairs.sum(axis=0)
    centres, weight = x[np.argsort(-often, kind="stable")[:GROUPS]], np.sqrt(often + 1)
    for _ in range(GROUPING_STEPS):
        group = np.argmax(x @ centres.T, axis=1)
        for g in range(GROUPS):
            if (group == g).any():
                middle = np.average(x[group == g], axis=0, weights=weight[group == g])
                centres[g] = middle / (np.linalg.norm(middle) + 1e-9)
    return group


@dataclass
class Tables:
    """slot, unit, share: of each id (the end id is the last one). context: of
    each pair of units. groups: of each unit. group: logarithms for each context
    and group; inside: for each context and unit, given its group."""

    slot: np.ndarray
    unit: np.ndarray
    share: np.ndarray
    context: np.ndarray
    groups: np.ndarray
    group: np.ndarray
    inside: np.ndarray

    def prepare(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of ids laid end to end: slots, contexts, groups, and the part of the
        logarithm of the probability that the counts alone give."""
        unit = self.unit.take(ids)
        context = self.context.take(pairs_before(unit, sizes, int(self.unit[-1])))
        return self.slot.take(ids), context, self.groups.take(unit), self.inside.ravel().take(context.astype(np.int64) * UNITS + unit).astype(np.float32) + self.share.take(ids)


def pairs_before(unit: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """For each place the two units before it as one number; the end stands
    before each document."""
    last, second, begins = np.empty_like(unit), np.empty_like(unit), np.cumsum(sizes) - sizes
    last[1:], second[2:] = unit[:-1], unit[:-2]
    last[begins] = second[begins] = end
    second[begins[sizes > 1] + 1] = end
    return second.astype(np.int64) * UNITS + last


def context_table(top: np.ndarray) -> np.ndarray:
    """A context for each pair of units: its own, or that of the last unit."""
    out = np.tile(np.arange(UNITS, dtype=np.int16), UNITS)
    out[top] = UNITS + np.arange(len(top))
    return out


def tables_from(counts: np.ndarray, pairs: np.ndarray, top: np.ndarray, after: np.ndarray) -> Tables:
    """From counts of ids, of unit pairs (rows: the unit before) and of what
    follows the frequent pairs ``top``."""
    unit, share = unit_table(counts)
    alone = pairs.sum(axis=0) + 0.5
    two_ = discounted(pairs, (alone / alone.sum()).astype(np.float32))
    p = np.concatenate((two_, discounted(after, two_[top % UNITS])))
    groups = groups_of(pairs)
    member = np.zeros((UNITS, GROUPS), np.float32)
    member[np.arange(UNITS), groups] = 1
    group = p @ member
    p /= group[:, groups]
    inside = np.log(p, out=p)
    return Tables(
        slots_by_count(counts), unit.astype(np.int32), share.astype(np.float32), context_table(top), groups.astype(np.int32),
        np.log(np.maximum(group, 1e-30)).astype(np.float32), inside.astype(np.float16),
    )


def new_weights(slots: int = UNITS, seed: int = 7) -> dict[str, np.ndarray]:
    """Embeddings of slots beyond the units begin at zero."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(WIDTH)).astype(np.float32)
    return {
        "slot": np.concatenate((small(UNITS, WIDTH), np.zeros((max(0, slots - UNITS), WIDTH), np.float32))), "place": small(WINDOW, WIDTH) * np.float32(0.3),
        **{k: small(WIDTH, WIDTH) for k in ("query", "direct", "mixed")},
        "to_group": np.zeros((WIDTH, GROUPS), np.float32), "group_bias": np.zeros(GROUPS, np.float32),
    }


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
_SCALE = np.float32(1 / np.sqrt(WIDTH))


def two(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def attend(w: dict[str, np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Batched masked attention over windows of slots: embeddings, queries,
    weights with their sums, context. The weights aren't divided by their sums."""
    x = w["slot"].take(slots, axis=0)
    x += w["place"]
    q = (two(x) @ (w["query"] * _SCALE)).reshape(x.shape)
    a = q @ x.transpose(0, 2, 1)
    if a.max(initial=0) > 40:
        np.minimum(a, 40, out=a)
    np.exp(a, out=a)
    a *= _CAUSAL
    total = a @ np.ones((WINDOW, 1), np.float32)
    c = a @ x
    c /= total
    return x, q, a, total, c


def hidden(w: dict[str, np.ndarray], x: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = x @ w["direct"]
    h += c @ w["mixed"]
    return np.tanh(h, out=h)


def log_probabilities(w: dict[str, np.ndarray], t: Tables, h: np.ndarray, context: np.ndarray, group: np.ndarray, back: dict | None = None) -> np.ndarray:
    """Natural logarithms for the groups that come next. With ``back``, also the
    gradients of their negative sum: in back by weight, for h as "hidden"."""
    z = h @ w["to_group"]
    z += w["group_bias"]
    z += t.group.take(context, axis=0)
    if z.max(initial=0) > 80:
        np.minimum(z, 80, out=z)
    cells = np.arange(0, z.size, GROUPS) + group
    at = z.ravel().take(cells)
    np.exp(z, out=z)
    total = z @ np.ones((GROUPS, 1), np.float32)
    if back is not None:
        z /= total
        z.ravel()[cells] -= 1
        back["to_group"], back["group_bias"], back["hidden"] = h.T @ z, z.sum(axis=0), z @ w["to_group"].T
    return at - np.log(total[:, 0])


def gradients(w: dict[str, np.ndarray], t: Tables, before: np.ndarray, context: np.ndarray, group: np.ndarray, used: np.ndarray) -> dict:
    """Of the mean negative log-probability of the groups at used places, for
    windows of slots; "slot": a pair of slots and their gradients."""
    x, q, a, total, c = attend(w, before)
    at = np.flatnonzero(used.ravel())
    h = hidden(w, two(x), two(c))
    d: dict = {}
    log_probabilities(w, t, h.take(at, axis=0), context.ravel().take(at), group.ravel().take(at), d)
    dpre = np.zeros_like(h)
    dpre[at] = d.pop("hidden")
    h *= h
    dpre *= np.subtract(1, h, out=h)
    d["direct"], d["mixed"] = two(x).T @ dpre, two(c).T @ dpre
    dc = (dpre @ w["mixed"].T).reshape(x.shape)
    a /= total
    ds = dc @ x.transpose(0, 2, 1)
    ds -= np.einsum("nwd,nwd->nw", dc, c)[..., None]
    ds *= a
    dq = ds @ x
    dx = a.transpose(0, 2, 1) @ dc
    dx += ds.transpose(0, 2, 1) @ q
    dx = two(dx)
    dx += dpre @ w["direct"].T
    dx += two(dq) @ (w["query"] * _SCALE).T
    d["query"] = two(x).T @ two(dq) * _SCALE
    d["place"] = dx.reshape(x.shape).sum(axis=0)
    flat = before.ravel()
    order = np.argsort(flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    n = np.float32(1 / max(1, len(at)))
    return {k: g * n for k, g in d.items()} | {"slot": (flat[starts], np.add.reduceat(dx.take(order, axis=0), starts, axis=0) * n)}


@dataclass
class Adam:
    """Moments of the embeddings move only for slots that are met."""

    rate: float = RATE
    steps: int = 0
    mean: dict[str, np.ndarray] = field(default_factory=dict)
    square: dict[str, np.ndarray] = field(default_factory=dict)

    def move(self, w: dict[str, np.ndarray], d: dict) -> None:
        self.steps += 1
        first, second = 1 - 0.9**self.steps, 1 - 0.99**self.steps
        rate = np.float32(self.rate * min(1.0, self.steps / 20) / first * np.sqrt(second))
        for k, g in d.items():
            if k not in self.mean:
                self.mean[k], self.square[k] = np.zeros_like(w[k]), np.zeros_like(w[k])
            m, s = self.mean[k], self.square[k]
            if k == "slot":
                rows, g = g
                a, b = m.take(rows, axis=0) * np.float32(0.9), s.take(rows, axis=0) * np.float32(0.99)
                a += np.float32(0.1) * g
                b += np.float32(0.01) * g * g
                m[rows], s[rows] = a, b
                w[k][rows] -= rate * a / (np.sqrt(b) + np.float32(1e-6))
            else:
                m *= np.float32(0.9)
                m += np.float32(0.1) * g
                s *= np.float32(0.99)
                s += np.float32(0.01) * g * g
                w[k] -= rate * m / (np.sqrt(s) + np.float32(1e-6))


class Windows:
    """Of documents laid end to end as slots: their windows, made when asked for."""

    def __init__(self, slots: np.ndarray, sizes: np.ndarray, end: int, stride: int = STRIDE) -> None:
        begins = np.cumsum(sizes) - sizes
        self.stride, self.before = stride, np.empty_like(slots)
        self.before[1:] = slots[:-1]
        self.before[begins] = end
        number = 1 + np.maximum(0, -(-(sizes - WINDOW) // stride))
        doc = np.repeat(np.arange(len(sizes)), number)
        self.turn = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        self.start = begins[doc] + self.turn * stride
        self.left = (begins + sizes)[doc] - self.start

    def take(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slots before, the places of those that come next, and which of
        them count in their window."""
        column = np.arange(WINDOW)
        place = self.start[at][:, None] + column
        used = (column < self.left[at][:, None]) & ((self.turn[at] == 0)[:, None] | (column >= WINDOW - self.stride))
        np.minimum(place, len(self.before) - 1, out=place)
        return self.before.take(place), place, used


def score_sequences(w: dict[str, np.ndarray], t: Tables, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each document's probability; every id is scored once."""
    slots, context, group, out = t.prepare(ids, sizes)
    all_ = Windows(slots, sizes, int(t.slot[-1]))
    for k in range(0, len(all_.start), BLOCK):
        before, place, used = all_.take(slice(k, k + BLOCK))
        mark = np.flatnonzero(used.ravel())
        x, _, _, _, c = attend(w, before)
        h, at = hidden(w, two(x).take(mark, axis=0), two(c).take(mark, axis=0)), place.ravel().take(mark)
        out[at] += log_probabilities(w, t, h, context.take(at), group.take(at))
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=out, minlength=len(sizes)) / np.log(10)


@dataclass
class Trainer:
    """Weights that learn from ids of documents."""

    tables: Tables
    weights: dict[str, np.ndarray]
    adam: Adam = field(default_factory=Adam)
    seen: int = 0
    rng: np.random.Generator = field(default_factory=lambda: np.random.default_rng(11))

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        slots, context, group, _ = self.tables.prepare(ids, sizes)
        all_ = Windows(slots, sizes, int(self.tables.slot[-1]), WINDOW)
        order = self.rng.permutation(len(all_.turn))
        for k in range(0, len(order), BATCH):
            before, place, used = all_.take(order[k : k + BATCH])
            self.adam.move(self.weights, gradients(self.weights, self.tables, before, context.take(place), group.take(place), used))
        self.seen += len(ids)


@dataclass
class Trained:
    """counts: table (word, n) over the training documents, the end token as
    the empty word; tokens, distinct: their sum and number. laid: what
    lay_documents made of all documents."""

    counts: DataFrame
    laid: DataFrame
    tokens: int
    distinct: int
    tables: Tables
    weights: dict[str, np.ndarray]
    path: str
    pattern: str


LAID = "row long, doc_id long, held_out boolean, ids binary, word string, id int, n long"


def lay_documents(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """Three kinds of rows in one pass: documents as ids (row, doc_id, held_out,
    ids); counts of words (word, n) and of ids (id, n) that a task met in
    training documents."""

    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.string(), "id": pa.int32(), "n": pa.int64()}

    def rows(size: int, **columns) -> pa.RecordBatch:
        values = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(values, names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sw = subwords(path, pattern)
        lexicon, row, by_id = Lexicon(sw), TaskContext.get().partitionId() << 33, np.zeros(sw.size + 1, np.int64)

        def counts() -> Iterator[pa.RecordBatch]:
            words, n, ids = lexicon.counted()
            by_id[:] += ids
            for k in range(0, len(words), 20_000):
                yield rows(len(words[k : k + 20_000]), word=words[k : k + 20_000], n=n[k : k + 20_000])

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                if len(lexicon.index) > KNOWN_WORDS:
                    yield from counts()
                    lexicon.clear()
                split = [words_of(x) for x in part.column(2).to_pylist()]
                laid, size = lexicon.lay_out(split), part.num_rows
                learn = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                taken = laid.words[np.repeat(learn, [len(w) for w in split])]
                lexicon.count[: len(lexicon.index)] += np.bincount(taken, minlength=len(lexicon.index))
                by_id[sw.size] += int(learn.sum())
                raw, cuts = laid.ids.astype(sw.dtype).tobytes(), np.append(0, np.cumsum(laid.sizes)) * sw.dtype.itemsize
                ids = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield rows(size, row=np.arange(row, row + size), doc_id=part.column(0), held_out=part.column(1), ids=ids)
                row += size
        yield from counts()
        at = np.flatnonzero(by_id)
        yield rows(len(at), id=at, n=by_id[at])
        if by_id[sw.size]:
            yield rows(1, word=[""], n=by_id[sw.size :])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"))
    return stored(texts.mapInArrow(run, LAID), "laid")


def documents_of(batches: Iterator[pa.RecordBatch], dtype: np.dtype, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """ids and sizes of documents laid end to end, some ten thousand ids at a
    time, with their rows; the first column has the ids."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(0).to_pylist()], dtype=np.int64) // dtype.itemsize
        turn = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield np.frombuffer(b"".join(part.column(0).to_pylist()), dtype).astype(np.int32), sizes[a:b], part


def cell_counts(ids: DataFrame, units: np.ndarray, dtype: np.dtype, top: np.ndarray | None = None) -> np.ndarray:
    """How often a unit follows another (rows: the unit before, the end before
    each document), or follows each of the pairs ``top``, in ids. So many sums
    reach the driver at most as there are rows and units."""
    row_of = None if top is None else context_table(top)
    size = (UNITS if top is None else len(top)) * UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for flat, sizes, _ in documents_of(batches, dtype, 1 << 20):
            now = units.take(flat)
            row = pairs_before(now, sizes, int(units[-1]))
            if top is None:
                row %= UNITS
            else:
                row = row_of.take(row).astype(np.int64) - UNITS
                now, row = now[row >= 0], row[row >= 0]
            total += np.bincount(row * UNITS + now, minlength=size)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    got = ids.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    cells = got.select(F.col("cell").cast("int").alias("cell"), "n").toArrow()
    total = np.zeros(size, np.float32)
    total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return total.reshape(-1, UNITS)


PART = "piece int, salt int, seen long, numbers binary"


def averaged(parts: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
    """The mean of trainers' weights by what each has seen. A task adds up the
    rows of some pieces as they pass, first by piece and salt, then by piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for piece, seen, numbers in zip(batch["piece"], batch["seen"], batch["numbers"], strict=True):
                had, mean = sums.get(piece, (0, 0.0))
                new = np.frombuffer(numbers, np.float32).astype(np.float64)
                sums[piece] = (had + seen, mean + (new - mean) * (seen / (had + seen)))
        yield pd.DataFrame([(p, 0, n, m.astype(np.float32).tobytes()) for p, (n, m) in sums.items()], columns=["piece", "salt", "seen", "numbers"])

    got = parts.repartition("piece", "salt").mapInPandas(run, PART).repartition("piece").mapInPandas(run, PART).collect()
    if not got:
        return None
    flat, out, at = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in sorted(got, key=lambda r: r["piece"])]), {}, 0
    for k, w in like.items():
        out[k] = flat[at : at + w.size].reshape(w.shape).copy()
        at += w.size
    return out


def train_weights(laid: DataFrame, ids: int, tables: Tables, dtype: np.dtype, rounds: int = ROUNDS, trainer_ids: int = TRAINER_IDS) -> dict[str, np.ndarray]:
    """laid: row and ids of the training documents, each of which is in one round."""
    spark, weights = laid.sparkSession, new_weights(int(tables.slot.max()) + 1)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps((tables, weights)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            trainer = Trainer(*pickle.loads(sent.value))
            for flat, sizes, _ in documents_of(batches, dtype):
                trainer.learn(flat, sizes)
            if not trainer.seen:
                return
            numbers = np.concatenate([w.ravel() for w in trainer.weights.values()])
            cuts = range(0, len(numbers), PIECE)
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array(range(len(cuts)), pa.int32()), "salt": pa.array([TaskContext.get().partitionId() % 64] * len(cuts), pa.int32()),
                "seen": [trainer.seen] * len(cuts), "numbers": [numbers[k : k + PIECE].tobytes() for k in cuts],
            })

        chosen = laid.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn).select("ids")
        parts = chosen.coalesce(max(1, ids // rounds // trainer_ids)).mapInArrow(run, PART)
        weights = averaged(parts, weights) or weights
    return weights


def train(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    sw = subwords(path, pattern)
    laid = lay_documents(docs, path, pattern, id_col, text_col)
    counts = stored(laid.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    by_id = np.zeros(sw.size + 1)
    for row in laid.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # a row per subword at most
        by_id[row["id"]] = row["n"]
    rows, ids = laid.where("NOT held_out").select("row", "ids"), int(by_id.sum())
    few = rows.select("ids").coalesce(max(1, ids // COUNTED_IDS))
    units, _ = unit_table(by_id)
    pairs = cell_counts(few, units, sw.dtype)
    top = frequent_pairs(pairs)
    tables = tables_from(by_id, pairs, top, cell_counts(few, units, sw.dtype, top))
    weights = train_weights(rows, ids, tables, sw.dtype)
    return Trained(counts, laid, int(tokens or 0), int(distinct or 0), tables, weights, path, pattern)


def at_least(counts: DataFrame, most: int) -> int | None:
    """The least n such that at most ``most`` rows have that n or more; from a
    histogram, without a sort. None where even the largest are too many."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    limit, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        total += row["rows"]
        if total > most:
            break
        limit = row["n"]
    return limit


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """At most ``most`` of the most frequent words, of bounded length."""
    short = counts.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("word") != ""))
    limit = at_least(short, most)
    return {} if limit is None else {r["word"].encode(): r["n"] for r in short.where(F.col("n") >= limit).select("word", "n").toLocalIterator()}


SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<string>"


def score(docs: DataFrame, model: Trained, id_col: str = "doc_id", text_col: str = "text", laid: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. laid: the documents as ids, where they are at hand."""
    spark, path, pattern = docs.sparkSession, model.path, model.pattern
    laid = lay_documents(docs, path, pattern, id_col, text_col) if laid is None else laid
    laid = laid.where("row IS NOT NULL").select("ids", "row", "doc_id", "held_out")
    sw = subwords(path, pattern)
    frequent = frequent_words(model.counts)
    ids, sizes = sw.spell(list(frequent))
    raw, cuts = ids.astype(sw.dtype).tobytes(), (np.append(0, np.cumsum(sizes)) * sw.dtype.itemsize).tolist()
    logs = {raw[a:b]: float(np.log10(n + 1)) for a, b, n in zip(cuts, cuts[1:], frequent.values(), strict=False)}
    ends = model.counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast(pickle.dumps((model.tables, model.weights, logs, float(np.log10(ends + 1)), ends > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, w, frequent, end_log, end_known = pickle.loads(sent.value)
        sw = subwords(path, pattern)
        frequent[np.array([sw.size], sw.dtype).tobytes()] = end_log
        for flat, sizes, part in documents_of(batches, sw.dtype):
            scores = score_sequences(w, t, flat, sizes)
            keys, begins = sw.words(flat)
            logs = np.array([frequent.get(k, np.nan) for k in keys])
            doc = np.searchsorted(np.cumsum(sizes), begins, side="right")
            unknown = np.isnan(logs)
            rare: list[list[str]] = [[] for _ in sizes]
            for i in np.flatnonzero(unknown).tolist():
                rare[doc[i]].append(sw.word(keys[i]))
            per = lambda values: np.bincount(doc, values, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1), part.column(2), part.column(3), pa.array(per(None).astype(np.int64)), pa.array(per(~unknown).astype(np.int64) - (0 if end_known else 1)),
                    pa.array(per(np.where(unknown, 0.0, logs))), pa.array(scores), pa.array(rare, pa.list_(pa.string())),
                ],
                names=["row_id", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare"],
            )

    scored = stored(laid.mapInArrow(run, SCORED), "scored")
    rare = scored.select("row_id", F.explode("rare").alias("word")).join(model.counts, "word").groupBy("row_id").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    spread = float(np.log10(model.tokens + model.distinct + 1))
    return scored.drop("rare").join(rare, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        "score",
    )
