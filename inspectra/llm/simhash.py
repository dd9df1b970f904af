"""SimHash near-deduplication by anchor-point covering.

A document's fingerprint has a bit set where over half of the XXH64 hashes
(seed 42) of its word shingles have it set. Fingerprints that differ in at most
four bits are linked.

The 64 bits are cut into three blocks; of two linked fingerprints some block
differs in one bit at most. Anchors of a block are the 4096 words of the
binary Golay code of length 23, whose covering radius is 3: every block value
lies within 3 of exactly one of them, its home. A fingerprint is replicated to
all anchors within radius plus threshold, 3 + 1 bits of its block (six on
average for all but the values nearest to the code). So one end's home anchor
always has the other end too, and each anchor compares the fingerprints at home
there with all that reached it.

Equal fingerprints count once. An anchor with more than ``ANCHOR_ROWS`` members
is dealt out as pairs of chunks; a task never holds more than two chunks. What
leaves an anchor is a spanning forest, not its pairs. Components come from
alternating large-star and small-star steps over stored edges.

Defined cases: null counts as empty; a text without words has fingerprint zero
and is linked like any other; fewer words than a shingle has make one shingle;
a null id joins in, but is no component's smallest id unless all its ids are
null; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.llm.common import keep_decided, stored

SHINGLE = 4
SEED = 42
THRESHOLD = 4
ANCHOR_ROWS = 32_000
#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
COMPARED = 1 << 21
#: Bits beyond the covering radius to which ``covering`` replicates.
REPLICA_BITS = 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - reach].tolist(), ends[reach:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": bits.view(np.int64)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInPandas(run, "doc_id long, text_hash long, fp long")


def remainder(word: np.ndarray | int) -> np.ndarray | int:
    """Of a 23-bit word divided by the generator polynomial."""
    for bit in range(22, 10, -1):
        word = word ^ (word >> bit & 1) * (GOLAY << (bit - 11))
    return word


@lru_cache(maxsize=1)
def covering() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the pattern of at most 3 bits that leads to the home
    anchor, and the 5 patterns of 4 bits that lead to others (or -1)."""
    home, others = np.full(2048, -1), [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            at = remainder(pattern)
            if weight < 4:
                home[at] = pattern
            else:
                others[at].append(pattern)
    return home, np.array([(o + [-1] * 5)[:5] for o in others])


def anchors(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints: position in ``bits``, anchor (numbered through all
    blocks), whether it is home there."""
    home, others = covering()
    index, anchor, at_home = [], [], []
    for k, (first, size) in enumerate(BLOCKS):
        block = (bits >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64)
        syndrome = remainder(block)
        index.append(np.arange(len(bits)))
        anchor.append(k << 12 | (block ^ home[syndrome]) >> 11)
        at_home.append(np.ones(len(bits), dtype=bool))
        more = others[syndrome]
        row, col = np.nonzero(more >= 0)
        index.append(row)
        anchor.append(k << 12 | (block[row] ^ more[row, col]) >> 11)
        at_home.append(np.zeros(len(row), dtype=bool))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(at_home)


def replicate(fps: DataFrame) -> DataFrame:
    """anchor, fp, home: each distinct fingerprint at every anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(bits), 4096):
                part = bits[k : k + 4096]
                index, anchor, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(part[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.mapInArrow(run, "anchor int, fp long, home boolean")


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each link the smaller label, to the end."""
    while True:
        a, b = label[a], label[b]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (as index pairs) of the links between fingerprints at
    home and all others. A few leaders first gather dense groups; a block of
    rows from one group is then compared only with what lies outside it."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(home)
    for _ in range(16):
        alone = rows[label[rows] == rows]
        if len(fp) < 256 or not len(alone):
            break
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[alone[len(alone) // 2]]) <= threshold)
        settle(label, np.full(len(near), near[0]), near)
    rows = rows[np.argsort(label[rows], kind="stable")]
    step = max(1, COMPARED // max(1, len(fp)))
    for k in range(0, len(rows), step):
        block = rows[k : k + step]
        first = label[block[0]]
        columns = np.flatnonzero(label != first) if (label[block] == first).all() else np.arange(len(fp))
        r, c = np.nonzero(np.bitwise_count(fp[block][:, None] ^ fp[columns][None, :]) <= threshold)
        settle(label, block[r], columns[c])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def links(fps: DataFrame, threshold: int = THRESHOLD, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """u > v: links between distinct fingerprints that connect all components."""
    if threshold // len(BLOCKS) > REPLICA_BITS:
        raise ValueError(f"{len(BLOCKS)} blocks with replicas {REPLICA_BITS} bit beyond the radius cover fewer than {threshold} bits")
    reached = replicate(fps)
    sizes = reached.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))  # at most 3 x 4096 rows
    chunks = F.ceil(F.col("n") / anchor_rows).cast("int")
    large = F.broadcast(sizes.where(chunks > 1).select("anchor", chunks.alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = (
        reached.join(large, "anchor", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .select("anchor", "fp", "home", own.alias("own"), other.alias("other"))
        .select(F.shiftleft(F.col("anchor").cast("long"), 40).bitwiseOR(F.shiftleft(F.least("own", "other").cast("long"), 20)).bitwiseOR(F.greatest("own", "other").cast("long")).alias("cell"), "fp", "home")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bits, homes = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)

        def edges(fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            a, b = forest(fp, home, threshold)
            u, v = fp[a].view(np.int64), fp[b].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            cells = np.concatenate((cells, batch.column(0).to_numpy(zero_copy_only=False)))
            bits = np.concatenate((bits, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            homes = np.concatenate((homes, batch.column(2).to_numpy(zero_copy_only=False)))
            cuts = np.flatnonzero(np.diff(cells)) + 1
            if len(cuts):
                for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    yield edges(bits[a:b], homes[a:b])
                cells, bits, homes = cells[cuts[-1] :], bits[cuts[-1] :], homes[cuts[-1] :]
        yield edges(bits, homes)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node that isn't its own root, by alternating
    large-star and small-star steps until the edges no longer change."""
    edges = stored(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, as only a join of two plain shuffles can have its hot stars split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id, and first
    (the doc_id and text_hash of the component's row with the smallest id)."""
    rows = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("fp").agg(F.min(rank).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), threshold, anchor_rows))
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "firsts"), "root").select("fp", "first")  # written: so a hot root can be split
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The row with the smallest id of each group, with all its columns."""
    return keep_first(df, group(df, id_col, text_col, **settings), id_col, text_col)


def keep_first(df: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that ``marked`` names as first of their group, once each."""
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    decided = marked.select("doc_id", "text_hash", kept.alias("kept"))
    named = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return keep_decided(named, ["doc_id", "text_hash"], decided)
