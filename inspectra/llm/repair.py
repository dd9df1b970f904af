"""Conversation structure repair: the cheapest edits that make the turns alternate.

The rows of a conversation, by turn (nulls first; rows of one turn by role and
digest of text), have faults: blank, duplicate (role and text seen earlier) or
truncated; the first that fits counts. Edits of a row are Keep (0), Rerole to
user or assistant (1) and Delete (2; required for blank and duplicate rows);
Insert (5) adds an empty turn of user or assistant anywhere. A truncated row that
isn't deleted costs 5 more. The role initials of the result are (s?(ua)+)?. Of
the cheapest audits (the edits' initials in order) the ASCII-least is taken.

The search goes row by row over four states: nothing yet, after s, after u, after
a. Each state has one best audit, which is the last node of a chain: chains share
their beginnings. Nodes know their ancestors 1, 2, 4, ... steps back and a hash
of all that leads to them; where two audits cost the same, the first step in
which they differ is found by these, and equal hashes are verified step by step.
(Of two audits of the same rows and cost none is the beginning of the other.)

At scale: rows are sorted by ranges of (conversation, turn, ...), so a
conversation of any size is spread over tasks, and each task cuts its rows into
blocks of bounded size. A conversation that lies within one block is settled
there. Of the others each block gives its best audit from each state to each;
the blocks are chained by the same search, with blocks as steps. Its repaired
turns are hashed as they stream by in order, which is one task's work for one
conversation: a hash can't be split.

Defined cases: a null role or text is one space; rows without a conversation id
are one conversation; an empty role has no initial and can't be kept; an empty
table gives an empty result; other columns are ignored; texts of any length pass
whole. Identical rows are duplicates of each other, so their order is no matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.llm import common
from inspectra.llm.common import SPACES, bytes_of, stored, stored_in_small_batches

BLOCK_ROWS = 4096
BLOCK_CHARS = 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT = range(4)
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What may follow each state.
NEXT = {EMPTY: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = {"su", "ua", "au"}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audits as chains of steps that share their beginnings; 0 is the empty one."""

    def __init__(self) -> None:
        self.up: list[list[int]] = [[]]
        self.label, self.hash, self.size = [""], [0], [0]
        self.agreed: set[tuple[int, int]] = set()

    def add(self, node: int, label: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[-1]]):
            up.append(self.up[up[-1]][k])
            k += 1
        h = self.hash[node]
        for c in label:
            h = (h * BASE + ord(c)) % MODULUS
        self.up.append(up)
        self.label.append(label)
        self.hash.append(h)
        self.size.append(self.size[node] + len(label))
        return len(self.up) - 1

    def equal(self, a: int, b: int) -> bool:
        """Whether two audits of as many steps are equal."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b] or self.size[a] != self.size[b]:
            return False
        x, y = a, b
        while x != y and (x, y) not in self.agreed:
            if self.label[x] != self.label[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        self.agreed.add((a, b))
        return True

    def steps(self, node: int, count: int) -> list[str]:
        out = []
        for _ in range(count):
            out.append(self.label[node])
            node = self.up[node][0]
        return out[::-1]

    def less(self, a: int, last_a: str, b: int, last_b: str) -> bool:
        """Whether audit a and the step last_a come before audit b and last_b; a and
        b have as many steps."""
        differ = 0
        if not self.equal(a, b):
            x, y, differ = a, b, 1
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[x]) and not self.equal(self.up[x][k], self.up[y][k]):
                    x, y, differ = self.up[x][k], self.up[y][k], differ + (1 << k)
        return "".join([*self.steps(a, differ), last_a]) < "".join([*self.steps(b, differ), last_b])


def advance(audits: Audits, now: dict[int, tuple[int, int]], steps: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, int]]:
    """The best of each state after one step. now: state to cost and audit. steps:
    from state, to state, cost, label."""
    best: dict[int, tuple[int, int, str]] = {}
    for start, to, cost, label in steps:
        if start in now:
            total, node = now[start][0] + cost, now[start][1]
            if to not in best or total < best[to][0] or (total == best[to][0] and audits.less(node, label, *best[to][1:])):
                best[to] = (total, node, label)
    return {to: (cost, audits.add(node, label)) for to, (cost, node, label) in best.items()}


def _edits(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    out = [(s, s, DELETE, "D") for s in NEXT]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for s, follows in NEXT.items():
            out += [(s, follows[initial], KEEP + more, "K")] if initial in follows else []
            out += [(s, to, REROLE + more, "R") for c, to in follows.items() if c != "s"]
    grown = out + [(s, AFTER_U, cost + INSERT, label + "I") for s, to, cost, label in out if to != AFTER_U]
    return grown + [(s, AFTER_A, cost + INSERT, label + "I") for s, to, cost, label in grown if to == AFTER_U]


_EDITS = {(i, f): _edits(i, f) for i in ("s", "u", "a", "") for f in range(4)}
#: Edits before the first row: the last member is what they cost.
BEFORE = [(EMPTY, EMPTY, 0, ""), (EMPTY, AFTER_U, INSERT, "I"), (EMPTY, AFTER_A, 2 * INSERT, "II")]


def least(audits: Audits, now: dict[int, tuple[int, int]]) -> int:
    """The better of the states that may end a conversation."""
    ends = [s for s in (EMPTY, AFTER_A) if s in now]
    if len(ends) == 1 or now[ends[0]][0] != now[ends[1]][0]:
        return min(ends, key=lambda s: now[s][0])
    return ends[0] if audits.less(now[ends[0]][1], "", now[ends[1]][1], "") else ends[1]


def search(rows: list[tuple[str, int]], now: dict[int, tuple[int, int]], audits: Audits) -> dict[int, tuple[int, int]]:
    for initial, fault in rows:
        now = advance(audits, now, _EDITS[initial if initial in "sua" else "", fault])
    return now


def best_audits(rows: list[tuple[str, int]], start: int) -> dict[int, tuple[int, list[str]]]:
    """Of each state that the rows (initial, fault) can end in from a state the
    least cost, and each row's step."""
    audits = Audits()
    return {to: (cost, audits.steps(node, len(rows))) for to, (cost, node) in search(rows, {start: (0, 0)}, audits).items()}


def whole_audit(rows: list[tuple[str, int]]) -> tuple[int, list[str]]:
    """Cost and steps of a conversation; inserts before it belong to its first row."""
    audits = Audits()
    now = search(rows, advance(audits, {EMPTY: (0, 0)}, BEFORE), audits)
    cost, node = now[least(audits, now)]
    before, first, *rest = audits.steps(node, len(rows) + 1)
    return cost, [before + first, *rest]


def chained(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost, and of each block the states between which it is passed.
    blocks: (start, end) to cost and audit."""
    audits, ways = Audits(), []
    now = advance(audits, {EMPTY: (0, 0)}, BEFORE)
    for block in blocks:
        before = {node: state for state, (_, node) in now.items()}
        now = advance(audits, now, [(s, to, cost, audit) for (s, to), (cost, audit) in block.items()])
        ways.append({to: before[audits.up[node][0]] for to, (_, node) in now.items()})
    state = least(audits, now)
    cost, path = now[state][0], []
    for way in reversed(ways):
        path.append((way[state], state))
        state = way[state]
    return cost, path[::-1]


def applied(state: int, steps: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The turns that a row's step leaves, and the state after it."""
    out = []
    for edit in steps:
        if edit == "D":
            continue
        if edit == "K":
            out.append((role, text))
            state = NEXT[state][role[0]]
            continue
        state = AFTER_A if state == AFTER_U else AFTER_U
        out.append((NAMES[state], text if edit == "R" else ""))
    return state, out


def faulty(turns: DataFrame) -> DataFrame:
    """Stored rows with digest, initial and fault."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    own = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    rows = stored(rows.withColumn("digest", digest).withColumn("own", own), "turns")
    first = rows.groupBy("digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select(F.col("digest").alias("_digest"), F.col("first.row").alias("_first")), "repeats")
    small = bytes_of(first, F.lit(48)) <= common.BROADCAST_BYTES
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("row")) & (F.col("own") != BLANK)
    return rows.join(F.broadcast(first) if small else first, F.col("digest") == F.col("_digest"), "left").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("own")))


STATS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
FOUND = (
    "kind int, conv_id long, part int, block long, pos int, role string, text string, " + ", ".join(f"{c} long" for c in STATS) + ", first_turn long, last_turn long, "
    "first_initial string, last_initial string, cost long, audit string, result array<struct<role:string,text:string>>, ways array<struct<start:int,end:int,cost:long,steps:string>>"
)
COLUMNS = re.findall(r"(?:^|, )(\w+)", FOUND)
NUMBERS = set(re.findall(r"(?:^|, )(\w+) (?:int|long)\b", FOUND))
WHOLE, BLOCK, ROW = range(3)


class Block:
    """Some rows of a conversation that stand one after another."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.codes: list[tuple[str, int]] = []
        self.stats = dict.fromkeys(STATS, 0)
        self.turns: list[int | None] = [None, None]
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial, s = role[:1], self.stats
        s["rows"] += 1
        for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)):
            s[name] += fault == kind
        s["illegal"] += bool(self.codes) and self.codes[-1][0] + initial not in LEGAL
        if turn is not None:
            s["turns"] += turn != self.turns[1]
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        self.rows.append((role, text))
        self.codes.append((initial, fault))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def known(self) -> dict:
        return self.stats | {"first_turn": self.turns[0], "last_turn": self.turns[1], "first_initial": self.codes[0][0], "last_initial": self.codes[-1][0]}

    def settled(self) -> dict:
        cost, steps = whole_audit(self.codes)
        state, result = EMPTY, []
        for step, (role, text) in zip(steps, self.rows, strict=True):
            state, turns = applied(state, step, role, text)
            result += [{"role": r, "text": t} for r, t in turns]
        return self.known() | {"kind": WHOLE, "cost": cost, "audit": "".join(steps), "result": result}

    def open(self, part: int, block: int) -> list[dict]:
        ways = [{"start": s, "end": to, "cost": cost, "steps": " ".join(steps)} for s in NEXT for to, (cost, steps) in best_audits(self.codes, s).items()]
        at = {"part": part, "block": block}
        return [self.known() | at | {"kind": BLOCK, "ways": ways}, *(at | {"kind": ROW, "pos": k, "role": r, "text": t} for k, (r, t) in enumerate(self.rows))]


def audited(rows: DataFrame) -> DataFrame:
    """Whole conversations; blocks and rows of those that may go beyond a block."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, key, part, number, conversations = Block(), None, 0, 0, 0
        ready: list[dict] = []

        def end(found: list[dict]) -> None:
            ready.extend(f | {"conv_id": key} for f in found)

        def out() -> pd.DataFrame:
            columns = {c: [f.get(c) for f in ready] for c in COLUMNS}
            ready.clear()
            return pd.DataFrame({c: pd.array(x, dtype="Int64") if c in NUMBERS else pd.Series(x, dtype="object") for c, x in columns.items()})

        for batch in batches:
            convs, turns = (batch[c].astype("object").where(batch[c].notna(), None) for c in ("conv_id", "turn"))
            for conv, turn, role, text, fault, part in zip(convs, turns, batch["role"], batch["text"], batch["fault"], batch["part"], strict=True):
                conv, turn = (None if x is None else int(x) for x in (conv, turn))
                if not conversations or conv != key:
                    if block.rows:
                        end([block.settled()] if conversations > 1 and not number else block.open(part, number))
                    block, key, number, conversations = Block(), conv, 0, conversations + 1
                elif block.full():
                    end(block.open(part, number))
                    block, number = Block(), number + 1
                block.add(turn, role, text, int(fault))
            yield out()
        if block.rows:
            end(block.open(int(part), number))
        yield out()

    order = ["conv_id", "turn", "role", "digest", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return stored_in_small_batches(dealt.select("conv_id", "turn", "role", "text", "fault", "part").mapInPandas(task, FOUND), "audited")


def chain_blocks(blocks: DataFrame) -> DataFrame:
    """One row per conversation of several blocks, and of each block its steps."""

    def chain(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["part", "block"])
        stats = {c: int(found[c].sum()) for c in STATS}
        ends = list(zip(found["last_initial"][:-1], found["first_initial"][1:], strict=True))
        stats["illegal"] += sum(a + b not in LEGAL for a, b in ends)
        last = None
        for a, b in zip(found["first_turn"], found["last_turn"], strict=True):
            if not pd.isna(a):
                stats["turns"] -= a == last
                last = b
        ways = [{(w["start"], w["end"]): (w["cost"], w["steps"]) for w in ways} for ways in found["ways"]]
        cost, path = chained([{k: (c, s.replace(" ", "")) for k, (c, s) in w.items()} for w in ways])
        before = {to: label for _, to, _, label in BEFORE}[path[0][0]]
        steps = [w[way][1] for w, way in zip(ways, path, strict=True)]
        steps[0] = before + steps[0]
        turns = pd.concat([found["first_turn"], found["last_turn"]]).dropna()
        return pd.DataFrame({
            "conv_id": found["conv_id"].astype("Int64"), "part": found["part"], "block": found["block"], "steps": steps, "head": [True] + [False] * (len(found) - 1),
            **{c: stats[c] for c in STATS}, "first_turn": turns.min() if len(turns) else None, "last_turn": turns.max() if len(turns) else None, "cost": cost,
        }).astype({"first_turn": "Int64", "last_turn": "Int64"})

    kept = ["conv_id", "part", "block", *STATS, "first_turn", "last_turn", "first_initial", "last_initial", "ways"]
    schema = "conv_id long, part int, block long, steps string, head boolean, " + ", ".join(f"{c} long" for c in STATS) + ", first_turn long, last_turn long, cost long"
    return stored(blocks.select(kept).groupBy("conv_id").applyInPandas(chain, schema), "chained")


def stream_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, audit, sha of conversations whose rows, with their steps, come in order."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, state, sha, first, audit = None, False, EMPTY, hashlib.sha256(), True, []

        def end() -> pd.DataFrame:
            return pd.DataFrame({"conv_id": pd.array([key], dtype="Int64"), "audit": ["".join(audit)], "sha": [sha.hexdigest()]})

        for batch in batches:
            convs = batch["conv_id"].astype("object").where(batch["conv_id"].notna(), None)
            for conv, step, role, text in zip(convs, batch["step"], batch["role"], batch["text"], strict=True):
                conv = None if conv is None else int(conv)
                if not begun or conv != key:
                    if begun:
                        yield end()
                    key, begun, state, sha, first, audit = conv, True, EMPTY, hashlib.sha256(), True, []
                audit.append(step)
                state, turns = applied(state, step, role, text)
                for r, t in turns:
                    sha.update(f"{'' if first else chr(10)}{r}:{t}".encode())
                    first = False
        if begun:
            yield end()

    order = ["conv_id", "part", "block", "pos"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "step", "role", "text").mapInPandas(task, "conv_id long, audit string, sha string")


class Repaired:
    """found: whole conversations, blocks and rows; chains: the steps of blocks."""

    def __init__(self, found: DataFrame, chains: DataFrame) -> None:
        self.found, self.chains = found, chains

    def open_rows(self) -> DataFrame:
        """Rows of conversations of several blocks, with their steps."""
        c = self.chains.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("block").alias("_b"), F.split("steps", " ").alias("_steps"))
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b"))
        return self.found.where(F.col("kind") == ROW).join(c, same).select("conv_id", "part", "block", "pos", "role", "text", F.col("_steps")[F.col("pos")].alias("step"))

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
        counts = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        text = F.array_join(F.transform("result", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
        whole = self.found.where(F.col("kind") == WHOLE).select(*counts, F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
        hashes = stream_hashes(self.open_rows()).withColumnRenamed("conv_id", "_c")
        parts = self.chains.where("head").join(hashes, F.col("conv_id").eqNullSafe(F.col("_c"))).select(*counts, F.col("sha").alias("repaired_sha256"))
        return whole.unionByName(parts)

    def turns(self) -> DataFrame:
        """conv_id, place (ascending in a conversation), role, text of the repaired turns of
        whole conversations; those of several blocks are read by open_rows and applied."""
        return self.found.where(F.col("kind") == WHOLE).select("conv_id", F.posexplode("result").alias("place", "_r")).select("conv_id", "place", "_r.role", "_r.text")


def repair(turns: DataFrame) -> Repaired:
    """turns: conv_id, turn, role, text."""
    found = audited(faulty(turns))
    return Repaired(found, chain_blocks(found.where(F.col("kind") == BLOCK)))
