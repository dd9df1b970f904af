"""Substring deduplication with difference-cover anchors.

A window is 50 consecutive words of one document. Every word that a window
covers is removed if that word sequence also starts in a document with a
smaller id; windows are judged on the input.

1. Anchors: windows of 20 words are hashed only where their position modulo 31
   lies in a difference cover. For any two positions some shift below 31 takes
   both into the cover, and 20 + 31 - 1 = 50, so two equal windows of 50 words
   share an anchor at the same offset in both.
2. Anchors that only one document has are dropped. Each of the others extends
   to the windows of 50 words around it; these are hashed to 128 bits (32 name the zone).
3. Of equal windows those outside the document with the smallest id are
   removed.

Each task first settles what it can see itself: an anchor that two of its
documents share is known to match, and of equal windows all but those of its
smallest id are known to go. So a passage that is in a third of all documents
reaches the shuffle once per task, not once per document. What is left is dealt
by zones: numbers that words have in common with most of their neighbours, and
that depend on the words alone. So a document's matches come together in runs,
and the rows that carry their intervals on are one for each document and zone,
however many tasks there are. Texts aren't shuffled while the intervals found are few enough to broadcast (checked).

Defined cases: null has no words; texts of fewer than 50 words lose none; rows
with a null id neither lose words nor take any from others; rows that repeat
an id don't take words from each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectra.llm.common import bytes_of, stored

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
#: Words of the windows whose least hash names a zone; bits that a zone takes of
#: an anchor's and of a window's hash.
ZONE_WORDS = 8
ANCHOR_ZONE, WINDOW_ZONE = 24, 32
CHUNK_WORDS = 400_000
TASK_ANCHORS = 1_000_000
BROADCAST_BYTES = 32 << 20
HELD_BYTES = 8 << 20

_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MULTIPLY[0] + (b ^ b >> np.uint64(29)) * _MULTIPLY[1]
    x ^= x >> np.uint64(32)
    x *= _MULTIPLY[2]
    return x ^ x >> np.uint64(31)


def _shifted(h: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate((h[by:], np.zeros(min(by, len(h)), dtype=h.dtype)))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on, by doubling. Positions
    with fewer words left have no meaning."""
    out, done, power, step = None, 0, words, 1
    while step <= size:
        if size & step:
            out, done = (power, step) if out is None else (_mix(out, _shifted(power, done)), done + step)
        step *= 2
        if step <= size:
            power = _mix(power, _shifted(power, step // 2))
    return out


def zoned(words: np.ndarray, size: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the ``size`` words from each position on, led by their zone in
    ``bits`` bits: equal words have equal zones, and so have most neighbours, as
    it is made of the least hash of ``ZONE_WORDS`` words among them."""
    least, done, all_ = window_hashes(words, ZONE_WORDS), 1, size - ZONE_WORDS + 1
    while done < all_:
        step = min(done, all_ - done)
        least = np.minimum(least, _shifted(least, step))
        done += step
    rest = np.uint64(64 - bits)
    return _mix(least, least) >> rest << rest | hashes >> np.uint64(bits)


def by_zone(rows: DataFrame, hash_col: str, bits: int) -> DataFrame:
    return rows.withColumn("zone", F.shiftright(hash_col, 64 - bits)).repartition("zone")


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w, seed) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def chunks(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Rows with at least a window's words, some hundred thousand words at a time."""
    rows, split, size = [], [], 0
    for k, text in enumerate(batch["text"]):
        words = words_of(text)
        if len(words) < WINDOW:
            continue
        rows.append(k)
        split.append(words)
        size += len(words)
        if size >= CHUNK_WORDS:
            yield batch.iloc[rows], split
            rows, split, size = [], [], 0
    if rows:
        yield batch.iloc[rows], split


def flat(split: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All words; of each word its row, its position, and how many words are left."""
    sizes = np.array([len(s) for s in split])
    row = np.repeat(np.arange(len(split)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [w for s in split for w in s], row, at, sizes[row] - at


def groups(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def settle_anchors(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """kind 0: of one document as far as this task sees; 1: known to match;
    2: stands for those of kind 1 with its anchor."""
    order = np.lexsort((doc, anchor))
    anchor, doc, place = anchor[order], doc[order], place[order]
    starts = groups(anchor)
    sizes = np.diff(np.append(starts, len(anchor)))
    shared = doc[starts] != doc[starts + sizes - 1] if len(starts) else np.zeros(0, dtype=bool)
    kind = np.repeat(shared, sizes).astype(np.int8)
    first = starts[shared]
    out = pd.DataFrame({
        "anchor": np.concatenate((anchor, anchor[first])).view(np.int64), "doc_id": np.concatenate((doc, doc[first])),
        "place": np.concatenate((place, place[first])).astype(np.int32), "kind": np.concatenate((kind, np.full(len(first), 2, dtype=np.int8))),
    })
    return out.iloc[np.lexsort((out["place"], out["doc_id"]))]  # in this order the table packs well


def find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    size = WINDOW - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for rows, split in chunks(batch):
            words, row, at, left = flat(split)
            known = word_hashes(words, 1)
            hashes = zoned(known, size, window_hashes(known, size), ANCHOR_ZONE)
            pick = np.flatnonzero((left >= size) & in_cover[at % PERIOD])
            held.append((hashes[pick], rows["doc_id"].to_numpy(np.int64)[row[pick]], at[pick]))
            if sum(len(h[0]) for h in held) >= TASK_ANCHORS:
                yield settle_anchors(*map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield settle_anchors(*map(np.concatenate, zip(*held, strict=True)))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals, in order and joined where they touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:] - 1, len(begin) - 1)] if len(at) else end


def merged_by_key(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: a row of numbers for each interval. The different ones in order, and
    packed for each its intervals, joined where they touch (pairs of 32-bit
    integers)."""
    order = np.lexsort(keys.T[::-1])
    keys, begin, end = keys[order], begin[order], end[order]
    starts = groups(*keys.T)
    names, which = keys[starts], np.repeat(np.arange(len(starts), dtype=np.int64) << 34, np.diff(np.append(starts, len(keys))))
    a, b = merged(which + np.maximum(0, begin), which + end)
    cuts = np.searchsorted(a, np.arange(len(names) + 1, dtype=np.int64) << 34)
    pairs = (np.stack((a, b), axis=1) & ((1 << 34) - 1)).astype("<i4")
    return names, np.array([pairs[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], dtype=object)


def unpacked(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans or b"", dtype="<i4").reshape(-1, 2)


def kinds_of(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys) + ", spans binary"


def joined_by_zone(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spans: in each task the intervals of a key and zone, joined."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= TASK_ANCHORS:
                yield packed(pd.concat(held))
                held, size = [], 0
        if held:
            yield packed(pd.concat(held))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        names, spans = merged_by_key(rows[[*keys, "zone"]].to_numpy(np.int64), rows["begin"].to_numpy(np.int64), rows["end"].to_numpy(np.int64))
        return pd.DataFrame(names[:, :-1], columns=keys).assign(spans=spans)

    return rows.select(*keys, "zone", "begin", "end").mapInPandas(join, kinds_of(keys))


def by_document(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, spans (packed pairs of 32-bit integers) from rows with keys, zone,
    begin and end. A task joins what it has of a key and zone before the shuffle;
    after it rows come in the order of keys, and those of one key are joined as
    they pass, so that no more is held of it than its joined spans and
    ``HELD_BYTES``."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size, limit = None, [], 0, 0

        def joined() -> bytes:
            both = np.concatenate([unpacked(h) for h in held])
            return np.stack(merged(both[:, 0], both[:, 1]), axis=1).tobytes() if len(held) > 1 else held[0]

        for batch in batches:
            done: list[tuple] = []
            for *key, spans in zip(*(batch[k].tolist() for k in keys), batch["spans"], strict=True):
                if key != now:
                    if held:
                        done.append((*now, joined()))
                    now, held, size, limit = key, [], 0, HELD_BYTES
                held.append(spans)
                size += len(spans)
                if size > limit:
                    held = [joined()]
                    size = len(held[0])
                    limit = size + HELD_BYTES
            yield pd.DataFrame(done, columns=[*keys, "spans"])
        if held:
            yield pd.DataFrame([(*now, joined())], columns=[*keys, "spans"])

    lists = joined_by_zone(rows, keys).repartition(*keys).sortWithinPartitions(*keys)
    return stored(lists.mapInPandas(finish, kinds_of(keys)), name)


def attach(docs: DataFrame, spans: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Documents with their spans; broadcast where the spans are few bytes."""
    small = bytes_of(spans, F.octet_length("spans") + 48) <= BROADCAST_BYTES
    return docs.join(F.broadcast(spans) if small else spans, keys, how)


def settle_windows(high: np.ndarray, low: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """kind 0: of the smallest id that this task sees; 1: known to go."""
    order = np.lexsort((doc, low, high))
    high, low, doc, mark, place = high[order], low[order], doc[order], mark[order], place[order]
    starts = groups(high, low)
    least = np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
    gone = doc > least
    open_ = pd.DataFrame({"high": high[~gone].view(np.int64), "low": low[~gone].view(np.int64), "doc_id": doc[~gone], "mark": mark[~gone], "place": place[~gone].astype(np.int32), "run": np.int32(1), "kind": np.int8(0)})
    doc, mark, place = doc[gone], mark[gone], place[gone]
    order = np.lexsort((place, mark, doc))
    doc, mark, place = doc[order], mark[order], place[order]
    starts = groups(doc, mark, place - np.arange(len(place)))
    runs = np.diff(np.append(starts, len(place))).astype(np.int32)
    known = pd.DataFrame({"high": np.int64(0), "low": np.int64(0), "doc_id": doc[starts], "mark": mark[starts], "place": place[starts].astype(np.int32), "run": runs, "kind": np.int8(1)})
    return pd.concat((open_, known))


def find_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for rows, split in chunks(batch):
            words, row, at, left = flat(split)
            wanted = np.zeros(len(words) + 1, dtype=np.int64)
            begins = np.flatnonzero(at == 0)
            for first, size, spans in zip(begins, [len(s) for s in split], rows["spans"], strict=True):
                span = np.minimum(unpacked(spans), size) + first
                np.add.at(wanted, span[:, 0], 1)
                np.add.at(wanted, span[:, 1], -1)
            pick = np.flatnonzero((np.cumsum(wanted[:-1]) > 0) & (left >= WINDOW))
            ids, mark = rows["doc_id"].to_numpy(np.int64), rows["mark"].to_numpy(np.int64)
            one, two = word_hashes(words, 1), word_hashes(words, 2)
            high, low = zoned(one, WINDOW, window_hashes(one, WINDOW), WINDOW_ZONE)[pick], window_hashes(two, WINDOW)[pick]
            held.append((high, low, ids[row[pick]], mark[row[pick]], at[pick]))
            if sum(len(h[0]) for h in held) >= TASK_ANCHORS:
                yield settle_windows(*map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield settle_windows(*map(np.concatenate, zip(*held, strict=True)))


def with_marks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (the text's hash of 64 bits, to tell rows with one id
    apart; rows with equal texts lose the same words), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, mark, spans of the word positions to remove; ``docs`` as with_marks."""
    named = docs.where("doc_id IS NOT NULL")
    anchors = stored(named.mapInPandas(find_anchors, "anchor long, doc_id long, place int, kind byte"), "anchors")
    same, known = Window.partitionBy("zone", "anchor"), F.lit(0).cast("long").alias("zone")
    met = by_zone(anchors.where("kind <> 1"), "anchor", ANCHOR_ZONE).withColumns({"least": F.min("doc_id").over(same), "most": F.max("doc_id").over(same), "top": F.max("kind").over(same)})
    matched = met.where("kind = 0 AND (least <> most OR top = 2)").select("doc_id", "zone", "place").unionByName(anchors.where("kind = 1").select("doc_id", known, "place"))
    around = by_document(matched.select("doc_id", "zone", (F.col("place") - (PERIOD - 1)).alias("begin"), (F.col("place") + 1).alias("end")), ["doc_id"], "around-anchors")
    windows = stored(attach(named, around, ["doc_id"], "inner").mapInPandas(find_windows, "high long, low long, doc_id long, mark long, place int, run int, kind byte"), "windows")
    return by_document(beaten(windows), ["doc_id", "mark"], "removals")


def beaten(windows: DataFrame) -> DataFrame:
    """doc_id, mark, zone, begin, end: of equal windows those outside the document with the smallest id."""
    equal, known = Window.partitionBy("zone", "high", "low"), F.lit(0).cast("long").alias("zone")
    met = by_zone(windows.where("kind = 0"), "high", WINDOW_ZONE).withColumn("least", F.min("doc_id").over(equal)).where("doc_id > least")
    gone = met.select("doc_id", "mark", "zone", "place", F.lit(1).alias("run")).unionByName(windows.where("kind = 1").select("doc_id", "mark", known, "place", "run"))
    return gone.select("doc_id", "mark", "zone", F.col("place").alias("begin"), (F.col("place") + F.col("run") + (WINDOW - 1)).alias("end"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the words
    that stay, joined by one space)."""
    docs = with_marks(df, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part, out = batch.iloc[k : k + 512], []
                for text, spans in zip(part["text"], part["spans"], strict=True):
                    words = words_of(text)
                    total = len(words)
                    for a, b in unpacked(spans)[::-1].tolist():
                        del words[a:b]
                    out.append((total, total - len(words), b" ".join(words).decode()))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept_text": [o[2] for o in out]})

    return attach(docs, removals(docs), ["doc_id", "mark"], "left").select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_text string")
