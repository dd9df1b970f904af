"""SimHash near-deduplication, settled by exact similarity of word shingles.

Two documents are near copies when the sets of their five-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more. SimHash comes first: sets whose
fingerprints differ in at most ``COVERED`` bits meet at op9's anchor points, and
what these link is settled by the texts' own sets.

A similarity of 0.8 differs in 9.7 bits on average, more than anchor points can
cover. The pairs that SimHash leaves in different groups are therefore completed
by prefixes, which miss none: of sets that similar, sorted by one order for all,
each one's first few shingles (its prefix: a fifth of them and one) hold one of
the other's. Shingles are sorted by their hash, but such as a part of the
documents shows to be common come last. That decides how many rows meet, never
what is found.

Rows that meet at a shingle are compared by size, by a parity word (each
shingle flips one of 64 bits; as many bits as differ, shingles differ at least)
and, for sets of ``LARGE`` shingles or more, by SimHash with ``BITS`` bits at
most (similarity 0.8 differs in 9.7 on average, with a deviation of 2.9). The
parity word loses no pair; SimHash may pass over a pair of large sets (on the
given documents at 0.1 none of 48 pairs, 35 of them large, is lost). What is
left is settled by the texts' own sets, so every link is true.

What is left is then tested by bitmaps of parity bits, which lose no pair
either, before texts meet: after SimHash's pairs first one pair of each node,
which gathers large groups of copies, and then the pairs that lie between
components.

A shingle with more than ``CROWD`` rows has them first compared with the least
of its rows; only what this leaves in different components is compared pair by
pair, dealt out as pairs of chunks.

Defined cases: null counts as empty; a text without words has one empty
shingle; fewer words than a shingle has make one shingle; a null id is kept only
where all of its component's ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.llm import simhash
from inspectra.llm.common import BROADCAST_BYTES, bytes_of, stored, stored_in_small_batches

SHINGLE = 5
#: As a fraction: compared in whole numbers.
SIMILARITY = (4, 5)
#: Differing bits of the fingerprints that anchor points bring together; op9's take no more.
COVERED = 5
LARGE, BITS = 128, 24
CROWD = 16
#: The logarithm of a bitmap's most bits.
MOST_BITS = 15
CHUNK = 16_000
#: Bytes of a bitmap's fold that rows of crowded shingles carry.
FOLD = 128
#: Common shingles are looked for in one of so many documents, and counted as
#: common from so many of those on; so many go to the tasks at most.
PART, COMMON, MOST = 16, 50, 200_000
BUFFER = 1 << 16
#: Texts that a task turns into sets at once.
SLICE = 256
#: Pairs that a task compares at once.
COMPARED = 1 << 18
FIELDS = ["shingle", "node", "size", "parity", "fp"]


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending."""
    words = text.encode().lower().split()
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words or [b""]]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(shingle, len(ends)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], simhash.SEED) for a, b in zip(starts[: len(ends) - reach].tolist(), ends[reach:].tolist(), strict=True)], dtype="<u8"))


def prefix_size(size: int) -> int:
    part, whole = SIMILARITY
    return size - -(-size * part // whole) + 1


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """Parity word and SimHash of a set."""
    parity = np.bitwise_xor.reduce(np.uint64(1) << (hashes >> np.uint64(58)))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(parity.view(np.int64)), int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bits of a set, about twice as many as it has members."""
    bits = 1 << min(MOST_BITS, max(6, (2 * len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many parity bits two sets differ; they differ in as many members
    at least. The longer bitmap is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def folded(bits: bytes) -> bytes:
    """A bitmap folded to ``FOLD`` bytes at most: a shorter bitmap of the same set."""
    return bits if len(bits) <= FOLD else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, FOLD), axis=0).tobytes()


def may_differ(x: int, y: int, a: bytes, b: bytes) -> bool:
    """Whether sets of sizes x and y, by their bitmaps, differ no more than similar ones may."""
    part, whole = SIMILARITY
    return differing(a, b) * (whole + part) <= (x + y) * (whole - part)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    part, whole = SIMILARITY
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * whole >= (len(a) + len(b) - same) * part


def may_link(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    part, whole = SIMILARITY
    low, high, total = np.minimum(a["size"], b["size"]), np.maximum(a["size"], b["size"]), a["size"] + b["size"]
    differ = np.bitwise_count(a["parity"] ^ b["parity"]).astype(np.int64)
    bits = np.bitwise_count(a["fp"] ^ b["fp"])
    return (low * whole >= high * part) & (differ * (whole + part) <= total * (whole - part)) & ((low < LARGE) | (bits <= BITS))


def common_shingles(texts: DataFrame, part: int = PART, common: int = COMMON) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), SLICE):
                yield pd.DataFrame({"shingle": np.concatenate([shingles(t) for t in batch["text"].iloc[k : k + SLICE]]).view(np.int64)})

    found = texts.where(F.pmod(F.xxhash64("text_hash", F.lit("part")), F.lit(part)) == 0).select("text").mapInPandas(run, "shingle long")
    counted = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= common)
    return np.sort(np.array([r[0] for r in counted.orderBy(F.desc("n"), "shingle").limit(MOST).select("shingle").collect()], dtype=np.int64).view(np.uint64))


def signatures(texts: DataFrame, part: int = PART, common: int = COMMON) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), size, parity, fp, bits, fold, prefix."""
    sent = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, part, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            rows = []
            for text in part.column(2).to_pylist():
                s = shingles(text)
                last = np.zeros(len(s), bool)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                order = np.concatenate((s[~last], s[last]))[: prefix_size(len(s))].copy()  # not a view of all
                bits = bitmap(s)
                rows.append((int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)), len(s), *sketch(s), bits, folded(bits), order.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            out = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out], names=["doc_id", "text_hash", "node", "size", "parity", "fp", "bits", "fold", "prefix"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, size long, parity long, fp long, bits binary, fold binary, prefix array<long>")


def arrays(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    got = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
    return got | {c: got[c].view(np.uint64) for c in ("parity", "fp")}


def at(rows: dict[str, np.ndarray], index) -> dict[str, np.ndarray]:
    return {c: x[index] for c, x in rows.items()}


def joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: np.concatenate((a[c], b[c])) for c in a}


def pairs_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    once = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], names=["u", "v"])


def first_pairs(rows: dict[str, np.ndarray], crowd: int = CROWD) -> pa.RecordBatch:
    """Of rows sorted by shingle: the pairs among each one's first ``crowd``
    rows, and of its other rows those with its first."""
    key = rows["shingle"]
    place = np.arange(len(key))
    start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0)) if len(key) else place
    rank, u, v = place - start, [], []
    for step in range(1, crowd):
        near = np.flatnonzero((rank >= step) & (rank < crowd))
        if not len(near):
            break
        near = near[may_link(at(rows, near), at(rows, near - step))]
        u.append(rows["node"][near])
        v.append(rows["node"][near - step])
    far = np.flatnonzero(rank >= crowd)
    far = far[may_link(at(rows, far), at(rows, start[far]))]
    return pairs_of(np.concatenate((*u, rows["node"][far])), np.concatenate((*v, rows["node"][start[far]])))


def runs_of(key: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of sorted rows, and how many rows each has;
    ``before`` rows of the first one came earlier."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.append(starts, len(key)))
    n[0] += before
    return key[starts], n


def meetings(reached: DataFrame, crowd: int = CROWD, buffer: int = BUFFER) -> DataFrame:
    """u, v, n: the pairs that meet (n is null), and each shingle with more than
    ``crowd`` rows as u, with its number of rows as n. Counted in the same pass,
    so that the prefixes are shuffled once."""

    def rows_of(u: pa.Array, v: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([u, v, n], names=["u", "v", "n"])

    def found(rows: dict[str, np.ndarray], keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = first_pairs(rows, crowd)
        yield rows_of(*pairs.columns, pa.nulls(pairs.num_rows, pa.int64()))
        many = n > crowd
        yield rows_of(pa.array(keys[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(n[many]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays(batch, FIELDS)
            held = rows if held is None else joined(held, rows)
            if len(held["node"]) >= buffer:
                keys, n = runs_of(held["shingle"], before)
                yield from found(held, keys[:-1], n[:-1])
                tail = np.flatnonzero(held["shingle"] == held["shingle"][-1])[:crowd]
                before = int(n[-1]) - len(tail)
                held = at(held, tail)  # later rows of this shingle need no more of it
        if held is not None:
            yield from found(held, *runs_of(held["shingle"], before))

    return reached.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "u long, v long, n long")


def by_bitmaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps differ no more than similar sets may. Bitmaps are
    a fraction of the texts' size, so that texts meet for few pairs."""
    side = lambda end, size, bits: nodes.select(F.col("node").alias(end), F.col("size").alias(size), F.col("bits").alias(bits))
    both = pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a, b = (batch.column(k).to_pylist() for k in range(2, 6))
            may = [may_differ(*one) for one in zip(n, m, a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(may, pa.bool_()))

    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs whose texts' sets are similar."""
    pairs = stored_in_small_batches(by_bitmaps(pairs, nodes), "pairs", 4 * SLICE)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = stored(nodes.select("node", F.col("least.text_hash").alias("text_hash")).join(wanted, "node"), "wanted")
    own = stored(texts.select("text_hash", "text").join(wanted, "text_hash").groupBy("node").agg(F.first("text").alias("text")), "texts")
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                u, v, a, b = (c.to_pylist() for c in part.columns)
                sets = {node: shingles(text) for node, text in {**dict(zip(u, a, strict=True)), **dict(zip(v, b, strict=True))}.items()}
                true = [similar(sets[i], sets[j]) for i, j in zip(u, v, strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(true, pa.bool_()))

    return stored_in_small_batches(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links", SLICE)


def covered(nodes: DataFrame) -> DataFrame:
    """u > v: the pairs that SimHash names. Nodes with equal fingerprints are
    paired with the least of them, and those with the forests that leave the
    anchor points."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    at_end = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias("node_" + end))
    links = stored(simhash.links(least.select("fp"), COVERED), "anchored")
    ends = links.join(at_end("u"), "u").join(at_end("v"), "v").select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v"))
    return ends.unionByName(nodes.select("fp", "node").join(least, "fp").where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias("root_" + end))
    both = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return both.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def crowd_pairs(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs at crowded shingles (with their number of chunks) whose ends
    are still in different components, and whose folded bitmaps don't tell them
    apart: of a family of texts that are alike but not alike enough few pairs
    leave a task."""
    label = F.coalesce("root", "node").alias("label")
    rows = crowded.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*FIELDS, "fold", label, "chunks")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(*FIELDS, "fold", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def compared(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = at(rows, np.argsort(rows["label"], kind="stable"))
            step = max(1, COMPARED // len(rows["node"]))
            kept = {c: rows[c] for c in ("size", "parity", "fp")}
            for k in range(0, len(rows["node"]), step):
                block = rows["label"][k : k + step]
                first = np.searchsorted(rows["label"], block[0], side="right")
                i, j = np.nonzero(block[:, None] < rows["label"][None, first:])
                i, j = i + k, j + first
                linked = may_link(at(kept, i), at(kept, j))
                i, j = i[linked], j[linked]
                near = np.fromiter((may_differ(*one) for one in zip(rows["size"][i].tolist(), rows["size"][j].tolist(), rows["fold"][i], rows["fold"][j], strict=True)), bool, len(i))
                if near.any():
                    yield pairs_of(rows["node"][i[near]], rows["node"][j[near]])

        def groups(rows: dict[str, np.ndarray], last: bool) -> tuple[list[dict[str, np.ndarray]], dict[str, np.ndarray]]:
            same = (rows["shingle"][1:] == rows["shingle"][:-1]) & (rows["low"][1:] == rows["low"][:-1]) & (rows["high"][1:] == rows["high"][:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(rows["node"])]
            parts = [at(rows, slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
            return (parts, {}) if last else (parts[:-1], parts[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays(batch, [*FIELDS, "fold", "label", "low", "high"])
            done, held = groups(joined(held, rows) if held else rows, False)
            for part in done:
                yield from compared(part)
        for part in groups(held, True)[0] if held else []:
            yield from compared(part)

    return dealt.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high").mapInArrow(run, "u long, v long")


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, chunk: int = CHUNK, part: int = PART, common: int = COMMON, buffer: int = BUFFER) -> DataFrame:
    """One row per input row: doc_id, text_hash, and first (the doc_id and
    text_hash of the component's row with the smallest id)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = stored_in_small_batches(signatures(texts, part, common), "signatures", 4 * SLICE)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("node").agg(F.min(rank).alias("least"), *(F.first(c).alias(c) for c in ("size", "parity", "fp", "bits", "fold", "prefix"))), "nodes")
    reached = nodes.select(F.explode("prefix").alias("shingle"), "node", "size", "parity", "fp")
    found = stored(meetings(reached, crowd, buffer).groupBy("u", "v").agg(F.max("n").alias("n")), "met")
    met = found.where("n IS NULL").select("u", "v")
    links = verified(covered(nodes), nodes, texts)
    left = stored(apart(met, simhash.components(links)), "left")
    links = links.unionByName(verified(left.groupBy("u").agg(F.min("v").alias("v")), nodes, texts))  # one for each node: gathers large groups
    links = links.unionByName(verified(apart(left, simhash.components(links)), nodes, texts))
    roots = simhash.components(links)
    sizes = found.where("n IS NOT NULL").select(F.col("u").alias("shingle"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    small = bytes_of(sizes, F.lit(64)) <= BROADCAST_BYTES
    members = nodes.select(F.explode("prefix").alias("shingle"), "node", "size", "parity", "fp", "fold")
    crowded = stored(members.join(F.broadcast(sizes) if small else sizes, "shingle").select(*FIELDS, "fold", "chunks"), "crowded")
    more = verified(crowd_pairs(crowded, roots).distinct(), nodes, texts)
    roots = simhash.components(links.unionByName(more))
    rooted = stored(nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.join(stored(rooted.groupBy("root").agg(F.min("least").alias("first")), "firsts"), "root").select("node", "first")
    return rows.join(named, "node").select("doc_id", "text_hash", "first")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The row with the smallest id of each group, with all its columns."""
    return simhash.keep_first(df, group(df, id_col, text_col, **settings), id_col, text_col)
