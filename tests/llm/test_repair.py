"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from inspectra.llm import queries, repair

R = random.Random(12)


def cheapest(rows):
    """(cost, audit) over all edits, for short conversations."""
    best = [(10**9, "")]

    def go(i, out, audit, cost):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit))
        if len(out) < len(rows) + 3:
            for c in "ua":
                if c == "u" and out[-1:] != "u" or c == "a" and out[-1:] == "u":
                    go(i, out + c, audit + "I", cost + 5)
        if i < len(rows):
            c, fault = rows[i]
            go(i + 1, out, audit + "D", cost + 2)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 * (fault == repair.CUT)
                for e, to in [("K", c)] * (c in ("s", "u", "a")) + [("R", "u"), ("R", "a")]:
                    go(i + 1, out + to, audit + e, cost + more + (e == "R"))

    go(0, "", "", 0)
    return best[0]


def by_strings(rows):
    """(cost, audit) by a table of whole strings, for long ones."""
    now = {"0": (0, "")}

    def grown(now):
        for frm, to in [("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")]:
            if frm in now:
                now[to] = min(now.get(to, (10**9, "")), (now[frm][0] + 5, now[frm][1] + "I"))
        return now

    now = grown(now)
    for c, fault in rows:
        then = {}
        for s, (cost, audit) in now.items():
            ways = [(s, 2, "D")]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 * (fault == repair.CUT)
                for to in {"0": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    ways += [(to, more, "K")] * (c == to) + [(to, more + 1, "R")] * (to != "s")
            for to, extra, e in ways:
                then[to] = min(then.get(to, (10**9, "")), (cost + extra, audit + e))
        now = grown(then)
    return min(now[s] for s in "0a" if s in now)


def some_rows(n):
    return [(R.choice(["s", "u", "a", "u", "a", "t", ""]), R.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_equals_all_edits():
    for _ in range(250):
        rows = some_rows(R.randrange(1, 8))
        cost, steps = repair.whole_audit(rows)
        assert (cost, "".join(steps)) == cheapest(rows) == by_strings(rows)


@pytest.mark.parametrize("cuts", [1, 3, 9])
def test_blocks_chain_to_the_same_audit(cuts):
    for _ in range(60):
        rows = some_rows(R.randrange(12, 60))
        at = [0, *sorted(R.sample(range(1, len(rows)), cuts)), len(rows)]
        blocks = [{(s, to): (c, "".join(x)) for s in repair.NEXT for to, (c, x) in repair.best_audits(rows[a:b], s).items()} for a, b in zip(at[:-1], at[1:], strict=True)]
        cost, path = repair.chained(blocks)
        before = {to: label for _, to, _, label in repair.BEFORE}[path[0][0]]
        assert (cost, before + "".join(b[w][1] for b, w in zip(blocks, path, strict=True))) == by_strings(rows)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(repair, "MODULUS", 1)  # all hashes are equal
    for _ in range(100):
        rows = some_rows(R.randrange(1, 30))
        cost, steps = repair.whole_audit(rows)
        assert (cost, "".join(steps)) == by_strings(rows)


def expected(turns, damage):
    """The query's rows by conversation, from plain loops."""
    out, by_conv = {}, {}
    for conv, turn, role, text in turns:
        rows = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{'' if conv is None else conv}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes = set(), []
        for _, role, text in rows:
            shown = text.rstrip(" \t\n\v\f\r")
            codes.append((role[:1], repair.BLANK if not shown else repair.DUPLICATE if (role, text) in seen else repair.SOUND if shown[-1] in ".!?" else repair.CUT))
            seen.add((role, text))
        known = [t for t, *_ in rows if t is not None]
        cost, audit = by_strings(codes)
        m, place, i, lines = len(audit.replace("D", "")), 0, 0, []
        for e in audit:
            if e != "D":
                lines.append((rows[i][1] if e == "K" else "user" if (place - m) % 2 == 0 else "assistant") + ":" + (rows[i][2] if e != "I" else ""))
                place += 1
            i += e != "I"
        faults = [f for _, f in codes]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count(repair.BLANK), faults.count(repair.DUPLICATE), faults.count(repair.CUT),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes[:-1], codes[1:], strict=True)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def odd_turns():
    texts = ["Fine.", "Yes!", "cut off", "", " \n", None, "What?", "a.", "b."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    rows = [(conv, turn, R.choice(roles), R.choice(texts) if R.random() < 0.4 else f"text {R.random()}.") for conv in range(40) for turn in range(R.randrange(1, 9))]
    rows += [(7, None, "user", "Fine."), (7, None, "user", "Fine."), (None, 3, "user", "x."), (None, None, "assistant", "y."), (50, None, None, None), (51, 9, "assistant", "é" * 100_000 + ".")]
    rows += [(99, turn, R.choice(["user", "assistant"]), f"{R.randrange(200)}" + R.choice([".", "!", ""])) for turn in range(0, 900, 2)]  # a hot one
    return [*rows, *[(99, 5, "user", "again.")] * 50]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("rows", "partitions"), [(4096, 1), (7, 5), (64, 3)])
def test_repair_equals_plain_loops(spark, monkeypatch, rows, partitions):
    monkeypatch.setattr(repair, "BLOCK_ROWS", rows)
    monkeypatch.setattr(repair.common, "BROADCAST_BYTES", 32 << 20 if partitions > 1 else -1)
    turns = odd_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS row", "'x' AS digest", "2 AS part").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.repair(df)
        got = {r.conv_id: tuple(r[c] for c in COUNTS) for r in found.conversations().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(turns, damage=False)


def test_query_on_odd_rows(spark, tmp_path):
    turns = odd_turns()
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    turns.append((dropped, 0, "user", "gone."))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "y").selectExpr("*", "0 AS fault")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(turns, damage=True) | {dropped: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}
    assert {r.conv_id: tuple(r[c] for c in COUNTS) for r in queries.op12_repair(spark, str(tmp_path)).collect()} == want
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op12_repair(spark, f"{tmp_path}/none").count() == 0
