"""Each operator against brute force on small rows with the odd cases: nulls,
empty and long texts, ties, repeats, empty tables, clashing column names."""

from __future__ import annotations

import hashlib
import io
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inspectra.llm import bpe, chat, decontam, exact_dedup, lm, quality, queries, simhash, substring, url_filter, warc

R = random.Random(4)
WORDS = ["the", "of", "ing", "tion", "and", "Ström", "été", "x", "###", "123", "don't", "ſ", "日本"]


def text(n: int) -> str:
    return "".join(R.choice(WORDS) + R.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(n))


PASSAGE = " ".join(f"w{k}" for k in range(70))
LONG = text(3000)
DOCS = [
    (1, "a b c"), (2, "abc"), (3, "a  b c "), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, LONG + " end"), (9, "a b c"), (9, "a b c"),
    (10, text(60) + PASSAGE + text(60)), (11, PASSAGE), (12, text(10) + PASSAGE[:250]), (12, text(70)), (None, PASSAGE), (None, "a b c"), (13, "é\u0301 İ ΑΣ <|endoftext|> x"),
    *((20 + k, text(R.choice([3, 40, 120]))) for k in range(30)), *((60 + k, PASSAGE + " " + "tail " * k) for k in range(6)),
]
CLASH = ("row_id", "digest", "best", "kind", "fp", "first", "spans", "mark", "ids", "n", "place", "_id", "_n", "y")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    return rows.withColumns({c: F.lit(c) for c in CLASH}).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def same_columns(before, after):
    assert after.columns == before.columns


def test_chat_layouts_come_to_the_same_turns(spark):
    odd = "\\ </s>[INST] <<SYS>> [/INST]\n<|text|> \\<s>"
    records = [
        {"conv_id": 1, "turn": 1, "role": "assistant", "text": odd}, {"conv_id": 1, "turn": 0, "role": "user", "text": None},
        {"conv_id": 2, "messages": [{"role": "system", "content": odd}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conv_id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": odd}]},
        {"conv_id": 4, "instruction": "do", "output": "done"}, {"conv_id": 5, "instruction": "do", "input": "this", "output": "done"},
        {"conv_id": 6, "prompt": "p", "completion": "c"}, {"conv_id": 7, "prompt": "p", "response": "r"}, {"conv_id": 8, "turn": 0, "role": "tool <|text|>", "text": odd}, {"conv_id": 9, "unknown": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",)], "record string")
    turns = chat.canonical_turns(df)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in turns.collect()}
    assert got[1, 0] == ("user", None) and got[1, 1] == ("assistant", odd) and got[2, 0] == ("system", odd)
    assert got[3, 0] == ("user", "q") and got[3, 1] == ("assistant", odd) and got[5, 0] == ("user", "do\n\nthis") and got[7, 1] == ("assistant", "r")
    assert len(got) == 2 + 3 + 2 + 2 * 4 + 1
    assert chat.unknown_layouts(df).agg(F.sum("records")).first()[0] == 2
    formatted = chat.format_turns(turns)
    read = {(r.conv_id, r.turn): r for r in chat.read_segments(formatted).collect()}
    assert {k: (r.role, r.text) for k, r in read.items()} == {k: (a, b or "") for k, (a, b) in got.items()}
    assert read[3, 1].loss_text == odd and read[3, 0].loss_text == ""
    whole = "".join(r.segment for r in formatted.where("conv_id = 2").orderBy("turn").collect())
    assert chat.parse_conversation(whole) == [("system", odd), ("user", "q"), ("assistant", "a")]
    assert chat.parse_conversation(formatted.where("conv_id = 8").first().segment) == [("tool <|text|>", odd)]


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "record string")
    assert chat.digest_conversations(chat.read_segments(chat.format_turns(chat.canonical_turns(none)))).count() == 0


PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "u", ""), (5, "u", "x" * 200_000), (6, "u", "\r\n\r\n WARC/1.1"), (6, "u", "\r\n\r\n WARC/1.1"), (None, "n", "<p>é</p>")]


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit(2)})
    manifest = warc.write_archives(pages.repartition(3), min_bytes=least)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()), key=repr)
    best = defaultdict(int)
    for i, _, html in PAGES:
        best[html or ""] = max(best[html or ""], i or 0)
    want = []
    for i, _, html in PAGES:
        p = html or ""
        again = len(p.encode()) >= least and best[p] != (i or 0) and sum((h or "") == p for _, _, h in PAGES) > 1
        want.append((i or 0, len(p.encode()), warc.base32_sha1(p.encode()), "revisit" if again else "response", best[p] if again else None))
    assert got == sorted(want, key=repr)


def test_warc_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_reader_loads_the_dictionary_and_rejects_unsound_files():
    records = [warc.record_bytes(k, "http://x", f"<p>page {k} of many</p>".encode() * 9, None, False) for k in range(50)]
    raw = warc.make_dictionary(records)
    pack = warc.compressor(raw)
    whole = warc.dictionary_frame(raw) + b"".join(map(pack.compress, records))
    assert list(warc.read_frames(io.BytesIO(whole))) == records
    packed = zstandard.ZstdCompressor().compress(raw)
    assert list(warc.read_frames(io.BytesIO(warc.dictionary_frame(packed) + b"".join(map(pack.compress, records))))) == records
    for broken in (whole[8:], whole[:-3], whole[:20]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_frames(io.BytesIO(broken)))
    for unsound in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9.9"), records[0].replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(unsound)
    with pytest.raises(ValueError):
        warc.row_of(*warc.parse_record(records[0].replace(b"page 0", b"page 1")))


URLS = ["http://WWW.Example.NET/en/1?x", "https://a.example.com/de/", "http://example.org/fr/#y", "http://b.net", "http://b.net?/", "http://notexample.net/en/", None, "no scheme", "x://h/p://q", "http://casino-win.example.org/en/77", "https://ththth.example.com/en/9", "http://h\n/a", ""]


def test_url_rules_and_model(spark):
    def brute(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = regex.split(r"[/?#]", rest)[0]
        path = regex.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(d + p, verdict) for verdict, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        return host, path, max(fits, key=lambda f: len(f[0]), default=None)

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for k, url in enumerate(URLS):
        host, path, rule = brute(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule[0] if rule else None)
        assert got[k].verdict == (rule[1] if rule else "block" if got[k].block_probability > 0.5 else "allow")
    assert got[9].block_probability > 0.5 > got[10].block_probability
    assert url_filter.judge(df.limit(0), model=([0.0] * 8, 0.0), buckets=8).count() == 0
    right = url_filter.judge(spark.createDataFrame([(y, u) for y, u in url_filter.LABELLED], "page_id long, url string")).select("page_id", (F.col("block_probability") > 0.5).cast("long").alias("p"))
    assert right.where("page_id = p").count() >= 0.95 * len(url_filter.LABELLED)


def squeezed(t):
    return regex.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup(docs, nothing, counters):
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.decide(docs, counters=counters).collect()
    assert len(got) == len(DOCS)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_hash[r.text_sha256]
        best = min(g)
        assert r.group_size == len(g) and r.keep_id == (None if best[1] else best[2])
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_hash.keys())
    kept = exact_dedup.keep_first(docs, counters=counters)
    same_columns(docs, kept)
    assert Counter(squeezed(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.decide(nothing).count() == 0 and exact_dedup.keep_first(nothing).count() == 0


def test_misra_gries_keeps_frequent_keys():
    import pandas as pd

    keys = [R.choice("aaab") if R.random() < 0.5 else str(R.random()) for _ in range(4000)]
    summary = pd.Series(dtype="float64")
    for k in range(0, 4000, 100):
        summary = exact_dedup.merge_summary(summary, pd.Series(keys[k : k + 100]).value_counts().astype(float), 10)
    assert len(summary) <= 10
    true = Counter(keys)
    for key, lower in summary.items():
        assert lower <= true[key]
    for key, n in true.items():
        if n > 4000 / 11:
            assert summary.get(key, 0) >= n - 4000 / 11


def labelled_rows(n):
    rows = []
    for k in range(n):
        good = k % 5 != 0
        body = " ".join(R.choice(["the", "of", "thing", "ention"]) for _ in range(60))
        rows.append((k, body if good else body.upper().replace(" ", "!! "), int(good)))
    return rows


def test_quality_learns_and_holds_out(spark, docs, nothing):
    rows = labelled_rows(1200)
    d = spark.createDataFrame(rows, "doc_id long, text string, q long").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    labels = d.where("doc_id < 500").select("doc_id", F.col("q").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 0)], "doc_id long, quality long"))
    model = quality.fit(d, labels)
    right = quality.score(d, model).join(d.select("doc_id", "q"), "doc_id").where("doc_id >= 500 AND kept = (q = 1)").count()
    assert right >= 0.98 * 700
    kept = quality.keep_good(d, labels)
    same_columns(d, kept)
    assert kept.where("q = 0").count() <= 5 and kept.where("q = 1").count() >= 950
    assert quality.score(docs, model).count() == len(DOCS) and quality.score(nothing, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.keep_good(nothing, labels.limit(0)).count() == 0


def test_views_that_cannot_tell_say_nothing():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.8).astype(float)
    good = np.column_stack([y + rng.normal(0, 0.05, 400), rng.normal(size=400)])
    noise = rng.normal(size=(400, 3))
    model = quality.co_train((good, noise), y, (good, noise), handed=50)
    assert sum(model.handed[0::2]) > 0 and sum(model.handed[1::2]) <= 5
    assert ((model.score(good, noise) > 0.5) == (y == 1)).mean() > 0.98


def edit_distance_within(item, body):
    row = [0] * (len(body) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(body, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark, docs, nothing):
    items = [(k, " ".join(R.choice(["alpha", "bravo", "charlie", "delta", "echo"]) + str(R.randrange(90)) for _ in range(12))) for k in range(6)] + [(6, None), (7, "short"), (8, "")]
    rows = []
    for k in range(40):
        body = items[k % 6][1]
        for _ in range(k // 6 * 2):
            at = R.randrange(len(body))
            body = body[:at] + R.choice(["", "z", body[at] + "q"]) + body[at + 1 :]
        rows.append((k, text(20) + body.upper().replace(" ", "\n ") + text(20)))
    rows += [(90, None), (91, ""), (92, items[0][1][:40])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: sorted(k for k, t in items if len(decontam.normalised(t)) >= decontam.MIN_ITEM and edit_distance_within(decontam.normalised(t), decontam.normalised(x)) <= int(0.1 * len(decontam.normalised(t)))) for i, x in rows}
    got = {r.doc_id: list(r.item_ids) for r in decontam.mark(d, b).collect()}
    assert got == want and 20 < sum(map(bool, want.values())) < 41
    clean = decontam.keep_clean(d, b)
    same_columns(d, clean)
    assert {r.doc_id for r in clean.collect()} == {i for i, m in want.items() if not m}
    assert decontam.keep_clean(d, b, block_chars=100).count() == clean.count()
    assert decontam.mark(nothing, b).count() == 0 and decontam.mark(docs, b.limit(0)).where("contaminated").count() == 0


def test_bpe_equals_the_library(docs, nothing):
    path = queries.word_bpe_path()
    library = Tokenizer.from_file(path)
    got = bpe.encode(docs, path).collect()
    want = Counter()
    for i, t in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.encoder(path).decode(bytes(got[0].ids)) == got[0].decoded
    assert bpe.digests(bpe.encode(nothing, path)).count() == 0


def test_bpe_on_hard_words():
    path = queries.word_bpe_path()
    library, mine = Tokenizer.from_file(path), bpe.encoder(path)
    hard = ["aaaaaaaaaaaaaaaaaa", "!!!!!...---", "x" * 300, "\x1c\x00\x7f a\x85b", "Ünïcödé ﬁ ﷺ", "'s''t'RE", "👩‍👩‍👧", "<|endoftext|><|startoftext|>a<|endoftext|>", "<|", "\u3000\u2028\ufeff"] + ["".join(R.choice("thenigsoa") for _ in range(R.randrange(1, 25))) for _ in range(3000)]
    for t, (ids, decoded) in zip(hard, mine.encode_batch(hard), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert [i for (i,) in struct.iter_unpack("<I", ids)] == want and decoded.decode() == library.decode(want, skip_special_tokens=False)


def brute_windows(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_substring_dedup(docs, nothing, small, monkeypatch):
    if not small:
        monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicate(docs).collect()]
    assert Counter(got) == Counter(brute_windows(DOCS))
    assert sum(r[2] for r in got) > 300
    assert substring.deduplicate(nothing).count() == 0


def test_cover_meets_every_pair_of_positions():
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + d) % substring.PERIOD in substring.COVER and (b + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("anchor_rows", [4, 32_000])
def test_simhash(docs, nothing, anchor_rows):
    got = simhash.group(docs, anchor_rows=anchor_rows).collect()
    fps = [(i, t, brute_fingerprint(t)) for i, t in DOCS]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((i, f) for i, _, f in fps)
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][2] ^ fps[b][2]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _, _) in enumerate(fps):
        least.setdefault(find(a), []).append(i)
    want = Counter((i, f, min((x for x in least[find(a)] if x is not None), default=None)) for a, (i, _, f) in enumerate(fps))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    same_columns(docs, kept)
    assert kept.count() == len(least)
    assert simhash.group(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_anchors_cover_every_link():
    rng = np.random.default_rng(0)
    home, others = simhash.covering()
    assert (home >= 0).all() and (others >= 0).sum() == 8855
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    at, anchor, is_home = simhash.anchors(x)
    mine, theirs = defaultdict(set), defaultdict(set)
    for k, a in zip(at[is_home], anchor[is_home], strict=True):
        mine[k].add(a)
    for k, a in zip(*simhash.anchors(y)[:2], strict=True):
        theirs[k].add(a)
    assert all(mine[k] & theirs[k] for k in range(3000))


def test_dense_anchor_groups_keep_their_components():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fp = np.unique(np.array([centre[k % 4] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for k in range(900)], dtype=np.uint64))
    a, b = simhash.forest(fp, np.ones(len(fp), bool))
    label = np.arange(len(fp))
    simhash.settle(label, a, b)
    slow = np.arange(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    simhash.settle(slow, i, j)
    assert (label == slow).all() and len(a) < len(fp)


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(40)] + [(k, 100) for k in range(101, 180)] + [(501, 500), (503, 502), (502, 501)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 180)}, **{k: 500 for k in (501, 502, 503)}}


def test_lm_counts_and_base(docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    model = lm.train(docs, path, pattern)
    got = lm.score(docs, model).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in DOCS]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert lm.score(nothing, model).count() == 0
    assert lm.score(docs, lm.train(nothing, path, pattern)).where("n_known = 0 AND train_tokens = 0").count() == len(DOCS)


def small_model(rng, scale=0.2):
    counts, pairs = rng.integers(0, 50, 3000).astype(float), rng.integers(0, 9, (lm.UNITS, lm.UNITS)).astype(float)
    top = lm.frequent_pairs(pairs)
    t = lm.tables_from(counts, pairs, top, rng.integers(0, 3, (len(top), lm.UNITS)).astype(float))
    return counts, t, {k: (p + rng.normal(0, scale, p.shape)).astype(np.float32) for k, p in lm.new_weights(int(t.slot.max()) + 1).items()}


def test_lm_is_a_distribution_and_windows_cover_once():
    rng = np.random.default_rng(0)
    counts, t, w = small_model(rng)
    unit, share = lm.unit_table(counts)
    assert np.allclose(np.bincount(unit, np.exp(share), minlength=lm.UNITS), 1)
    for c in (0, 1023, 1500, lm.UNITS + lm.PAIRS - 1):
        assert np.allclose(np.bincount(t.groups, np.exp(t.inside[c].astype(float)), minlength=lm.GROUPS)[np.unique(t.groups)], 1, atol=0.01)
    h, context = rng.normal(size=(2, lm.WIDTH)).astype(np.float32), np.array([3, 1500])
    assert np.allclose(sum(np.exp(lm.log_probabilities(w, t, h, context, np.full(2, g))) for g in range(lm.GROUPS)), 1, atol=1e-3)
    sizes = np.array([1, 31, 32, 33, 56, 57, 200])
    for stride in (lm.STRIDE, lm.WINDOW):
        _, place, used = lm.Windows(np.arange(sizes.sum()) % lm.UNITS, sizes, 0, stride).take(slice(None))
        assert sorted(place[used].tolist()) == list(range(sizes.sum()))


def test_lm_gradients():
    rng = np.random.default_rng(0)
    _, t, w = small_model(rng)
    before, context, group = rng.integers(0, 3000, (4, lm.WINDOW)), rng.integers(0, lm.UNITS + lm.PAIRS, (4, lm.WINDOW)), rng.integers(0, lm.GROUPS, (4, lm.WINDOW))
    used = rng.random((4, lm.WINDOW)) < 0.8

    def loss():
        x, _, _, _, c = lm.attend(w, before)
        h = lm.hidden(w, lm.two(x), lm.two(c)).reshape(x.shape)[used]
        return -lm.log_probabilities(w, t, h, context[used], group[used]).astype(float).mean()

    d = lm.gradients(w, t, before, context, group, used)
    rows, g = d["slot"]
    d["slot"] = np.zeros_like(w["slot"])
    d["slot"][rows] = g
    assert set(d) == set(w)
    for name, g in d.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = w[name][at], 1e-2
        w[name][at] = old + step
        up = loss()
        w[name][at] = old - step
        down = loss()
        w[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.08, abs=2e-4), name


def test_lm_scores_equal_a_plain_loop():
    """One document's score in float64, position by position."""
    rng = np.random.default_rng(5)
    counts, t, w = small_model(rng)
    ids = rng.integers(0, 3000, 90)
    w64 = {k: p.astype(float) for k, p in w.items()}
    slots, total = t.slot[ids], 0.0
    before = np.r_[int(t.slot[-1]), slots[:-1]]
    units = [int(t.unit[-1])] * 2 + t.unit[ids].tolist()
    for p in range(len(ids)):
        start = 0 if p < lm.WINDOW else (p - lm.OVERLAP) // lm.STRIDE * lm.STRIDE
        x = w64["slot"][before[start : p + 1]] + w64["place"][: p + 1 - start]
        a = np.exp((x[-1] @ w64["query"]) @ x.T / math.sqrt(lm.WIDTH))
        h = np.tanh(x[-1] @ w64["direct"] + (a / a.sum()) @ x @ w64["mixed"])
        c, u = int(t.context[units[p] * lm.UNITS + units[p + 1]]), units[p + 2]
        z = h @ w64["to_group"] + w64["group_bias"] + t.group[c]
        total += z[t.groups[u]] - math.log(np.exp(z).sum()) + float(t.inside[c, u]) + float(t.share[ids[p]])
    assert lm.score_sequences(w, t, ids, np.array([90]))[0] == pytest.approx(total / math.log(10), rel=1e-4)


def test_lm_counts_pairs_and_what_follows_them(spark):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, n).tolist() + [6] for n in (0, 1, 2, 30, 50)]
    rows = spark.createDataFrame([(bytearray(np.array(d, "<u2").tobytes()),) for d in docs], "ids binary").repartition(2)
    units, top = np.arange(7), np.array([3 * lm.UNITS + 2, 6 * lm.UNITS + 6, 6 * lm.UNITS + 1])
    pairs, after = np.zeros((lm.UNITS, lm.UNITS)), np.zeros((3, lm.UNITS))
    for d in docs:
        full = [6, 6, *d]
        for x, y, z in zip(full, full[1:], full[2:], strict=False):
            pairs[y, z] += 1
            after[:, z] += top == x * lm.UNITS + y
    assert (lm.cell_counts(rows, units, np.dtype("<u2")) == pairs).all() and (lm.cell_counts(rows, units, np.dtype("<u2"), top) == after).all()


def test_lm_masks_the_future():
    w = {k: p + 0.1 for k, p in lm.new_weights().items()}
    slots = np.arange(lm.WINDOW)[None, :] % 7
    other = slots.copy()
    other[0, 20:] = 500
    assert np.allclose(lm.attend(w, slots)[-1][0, :20], lm.attend(w, other)[-1][0, :20], atol=1e-6)


def test_lm_trains_on_every_training_document(spark, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(k, "w" + str(k % 9) + " the and of " * (k % 40)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    real = lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda parts, like: seen.append(parts.where("piece = 0").agg(F.sum("seen"), F.count(F.lit(1))).first()) or real(parts, like))
    monkeypatch.setattr(lm.train_weights, "__defaults__", (lm.ROUNDS, 500))
    model = lm.train(docs, path, pattern)
    laid = model.laid.where("NOT held_out").select(F.octet_length("ids").alias("n")).agg(F.sum("n")).first()[0] // 2
    assert len(seen) == lm.ROUNDS and sum(s[0] for s in seen) == laid and max(s[1] for s in seen) > 1


def test_words_are_spelled_together_as_alone():
    sw = lm.subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    words = [w.encode() for w in ["the", "don't", "x1y2", "été", "a\u00a0b", "ABC", "!!!'s", "\x1cq", "日本", "end", "it's,ok", "\u3000", "z"]]
    ids, sizes = sw.spell(words)
    cuts = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [sw.of(w) for w in words]
    keys, _ = sw.words(ids)
    assert [sw.word(k) for k in keys] == [w.decode() for w in words]


def test_subwords_are_the_public_encoding():
    ids = lm.subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(ids.encode.__self__, tiktoken.Encoding) and ids.of(b"hello") == ids.encode(" hello")
