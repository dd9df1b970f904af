"""Chat formatting with schema fingerprints.

Raw records come as JSON of several layouts. The nested field paths of a
record, those that some mapping names, are hashed; further fields change
nothing, whatever is in them. The fingerprint selects a declarative mapping - a
schema and one expression - that yields the canonical turns (conv_id, turn,
role, text). Rows of a table take the mapping that the fingerprint of their
schema selects, without passing through JSON. A record of unknown layout (also
one without a conv_id, or with a list or an object where a text is due) yields
no turns and is counted by ``unknown_layouts``.

The template writes one segment per turn; a formatted conversation is its
segments joined in turn order. Control strings inside roles and texts get a
backslash before them, and so does every backslash, so that reading back is
exact. The loss mask covers the texts of assistant turns.

Defined cases: null role or text counts as empty; turns that tie on their
number are ordered by role and text; a null conv_id or turn is a value of its
own and sorts first; an empty table gives an empty result; other columns are
ignored; an empty list of messages is a conversation without turns; a JSON
string may be as long as Spark lets it be (20 million characters by default: a
record with a longer one counts as unknown), a table's texts of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN = "struct<conv_id: bigint, turn: bigint, role: string, text: string>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths; a path through an array has ``[]``."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: Callable[[Column], Column]


def _turn(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    return F.struct(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))


def _listed(items: Callable[[Column], Column], role: str, text: str) -> Callable[[Column], Column]:
    return lambda r: F.transform(F.coalesce(items(r), F.array()), lambda m, i: _turn(r["conv_id"], i, m[role], m[text]))


def _pair(*parts: tuple[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return lambda r: F.array(*[_turn(r["conv_id"], F.lit(i), F.lit(role), text(r)) for i, (role, text) in enumerate(parts)])


LAYOUTS = [
    Layout("turn rows", ("conv_id", "role", "text", "turn"), "conv_id bigint, turn bigint, role string, text string", lambda r: F.array(_turn(r["conv_id"], r["turn"], r["role"], r["text"]))),
    Layout("messages", ("conv_id", "messages[].content", "messages[].role"), "conv_id bigint, messages array<struct<role: string, content: string>>", _listed(lambda r: r["messages"], "role", "content")),
    Layout("from and value", ("conv_id", "conversations[].from", "conversations[].value"), "conv_id bigint, conversations array<struct<`from`: string, value: string>>", lambda r: F.transform(_listed(lambda q: q["conversations"], "from", "value")(r), lambda t: t.withField("role", F.when(t["role"] == "human", "user").when(t["role"] == "gpt", "assistant").otherwise(t["role"])))),
    Layout("instruction", ("conv_id", "instruction", "output"), "conv_id bigint, instruction string, output string", _pair(("user", lambda r: r["instruction"]), ("assistant", lambda r: r["output"]))),
    Layout("instruction with input", ("conv_id", "input", "instruction", "output"), "conv_id bigint, instruction string, input string, output string", _pair(("user", lambda r: F.concat_ws("\n\n", r["instruction"], F.nullif(r["input"], F.lit("")))), ("assistant", lambda r: r["output"]))),
    Layout("prompt and completion", ("completion", "conv_id", "prompt"), "conv_id bigint, prompt string, completion string", _pair(("user", lambda r: r["prompt"]), ("assistant", lambda r: r["completion"]))),
    Layout("prompt and response", ("conv_id", "prompt", "response"), "conv_id bigint, prompt string, response string", _pair(("user", lambda r: r["prompt"]), ("assistant", lambda r: r["response"]))),
]


def _children(layouts: list[Layout]) -> dict[str, list[str]]:
    """The fields that layouts name: each with those of its list's members."""
    out: dict[str, set[str]] = {}
    for path in (p for layout in layouts for p in layout.paths):
        top, _, inner = path.partition(".")
        out.setdefault(top.removesuffix("[]"), set()).update([inner] if inner else [])
    return {k: sorted(v) for k, v in sorted(out.items())}


def _path(path: str, value: Column) -> Column:
    """The path of a value that is there; lists and objects in place of a single
    value are marked."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull(), None).when(kind.startswith("ARRAY"), path + "[]").when(kind.startswith("OBJECT"), path + "{}").otherwise(path)


def _member_path(name: str, inner: str) -> Callable[[Column], Column]:
    return lambda member: _path(f"{name}[].{inner}", F.try_element_at(member, F.lit(inner)))


def field_paths(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """The nested field paths of a JSON record that some layout names, in order; null
    if it isn't a JSON object. Whatever lies in other fields, at any depth, isn't
    looked at."""
    fields = F.try_variant_get(F.try_parse_json(record), "$", "map<string,variant>")
    paths = []
    for name, inner in _children(layouts).items():
        value = F.try_element_at(fields, F.lit(name))
        if not inner:
            paths.append(F.array(_path(name, value)))
            continue
        members = F.try_variant_get(value, "$", "array<map<string,variant>>")
        found = [F.array_distinct(F.transform(members, _member_path(name, k))) for k in inner]
        paths.append(F.when(F.size(members) > 0, F.concat(*found)).otherwise(F.array(_path(name, value))))
    return F.when(fields.isNotNull(), F.array_sort(F.array_compact(F.concat(*paths))))


def fingerprint(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """Hash of the nested field paths of a JSON record; null if it isn't a JSON object."""
    paths = field_paths(record, layouts)
    return F.when(paths.isNotNull(), F.xxhash64(F.array_join(paths, "|")))


def _marks(layout: Layout) -> list[str]:
    """The paths under which a layout is met: also with its lists empty."""
    full = "|".join(sorted(layout.paths))
    return [full, "|".join(sorted({p.partition(".")[0] for p in layout.paths}))] if "[]." in full else [full]


def canonical_turns(records: DataFrame, json_col: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of every record of a known layout."""
    mark = fingerprint(F.col(json_col), layouts)
    turns = F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        known = F.col("_mark").isin(*[F.xxhash64(F.lit(m)) for m in _marks(layout)])
        turns = F.when(known, layout.turns(F.from_json(json_col, layout.schema))).otherwise(turns)
    return records.select(F.col(json_col), mark.alias("_mark")).select(F.explode(turns).alias("t")).select("t.*")


def _paths(kind: DataType, before: str = "") -> set[str]:
    """Nested field paths of a table's column."""
    if isinstance(kind, ArrayType):
        return _paths(kind.elementType, before + "[]")
    if isinstance(kind, StructType):
        return set().union(*[_paths(f.dataType, (before + "." if before else "") + f.name) for f in kind]) if kind.fields else set()
    return {before}


def table_turns(rows: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of a table's rows, by the layout that the fingerprint
    of the table's field paths selects; where columns of several layouts clash,
    of those whose paths the table has all the one with the most."""
    have = _paths(rows.schema)
    named = have & {p for layout in layouts for p in layout.paths}
    by_mark = {_marks(layout)[0]: layout for layout in layouts}
    fits = [by_mark["|".join(sorted(named))]] if "|".join(sorted(named)) in by_mark else [layout for layout in layouts if set(layout.paths) <= have]
    if not fits:
        raise ValueError(f"no layout has its paths among {sorted(have)}")
    layout = max(fits, key=lambda each: len(each.paths))
    needed = sorted({p.split(".")[0].removesuffix("[]") for p in layout.paths})
    return rows.select(F.struct(*needed).alias("_row")).select(F.explode(layout.turns(F.col("_row"))).alias("t")).select("t.*")


def unknown_layouts(records: DataFrame, json_col: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Fingerprints without a mapping, and how many records have them."""
    known = [F.xxhash64(F.lit(m)) for layout in layouts for m in _marks(layout)]
    marks = records.select(fingerprint(F.col(json_col), layouts).alias("fingerprint"), F.col(json_col).alias("example"))
    return marks.where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(*known)).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"), F.min("example").alias("example"))


#: Control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>"]


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: role: what stands before and after the text.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER = ("<|role|>", "<|text|>", "<s>")


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds segment, loss_start and loss_length (both of code points; null
    outside the loss mask) to conv_id and turn."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = escaped(F.col("text"))
    segment = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        segment = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(segment)
    learned = role == "assistant"
    return turns.select(
        "conv_id", "turn", segment.alias("segment"),
        F.when(learned, len(MARKS["assistant"][0])).alias("loss_start"),
        F.when(learned, F.length(text)).alias("loss_length"),
    )


def read_segments(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss_text, formatted_chars of each segment."""
    seg = F.col("segment")
    name = F.lit(None).cast("string")
    inner = F.regexp_extract(seg, r"(?s)^<\|role\|>(.*)<\|text\|>(.*)<s>$", 2)
    for r, (before, after) in MARKS.items():
        fits = seg.startswith(before) & seg.endswith(after)
        name = F.when(fits, r).otherwise(name)
        inner = F.when(fits, F.substr(seg, F.lit(len(before) + 1), F.length(seg) - len(before) - len(after))).otherwise(inner)
    role = F.coalesce(name, unescaped(F.regexp_extract(seg, r"(?s)^<\|role\|>((?:[^\\<]|\\.|<(?!\|text\|>))*)<\|text\|>", 1)))
    inner = F.when(name.isNotNull(), inner).otherwise(F.regexp_extract(seg, r"(?s)^<\|role\|>(?:[^\\<]|\\.|<(?!\|text\|>))*<\|text\|>(.*)<s>$", 1))
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substr(seg, F.col("loss_start") + 1, F.col("loss_length"))))
    return formatted.select("conv_id", "turn", role.alias("role"), unescaped(inner).alias("text"), F.coalesce(loss, F.lit("")).alias("loss_text"), F.length(seg).cast("long").alias("formatted_chars"))


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole formatted conversation."""
    body = r"((?:[^\\<\[]|\\.|<(?!s>|/s>|<SYS>>|</SYS>>|\|role\|>|\|text\|>)|\[(?!INST\]|/INST\]))*)"
    turn = re.compile(rf"<s>\[INST\] {body} \[/INST\]|<<SYS>>\n{body}\n<</SYS>>\n\n|<\|role\|>{body}<\|text\|>{body}<s>| {body} </s>", re.S)
    plain = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
    out, at = [], 0
    while at < len(formatted):
        m = turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        user, system, role, other, assistant = m.groups()
        out.append(next((r, plain(t)) for r, t in (("user", user), ("system", system), (plain(role or ""), other), ("assistant", assistant)) if t is not None))
        at = m.end()
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(read: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation. The rows of a partition come in
    order and are hashed as they pass, so that no conversation is ever held."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key, begun, done = None, None, False, []

        def end() -> tuple:
            n, turns, chars, loss, total = state
            return (key, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for batch in batches:
            ids = batch["conv_id"].astype("object").where(batch["conv_id"].notna(), None)
            for conv, role, text, loss, chars in zip(ids, batch["role"], batch["text"], batch["loss_text"], batch["formatted_chars"], strict=True):
                conv = None if conv is None else int(conv)
                if not begun or conv != key:
                    if begun:
                        done.append(end())
                    key, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += int(chars)
            yield frame(done)
            done = []
        yield frame([end()] if begun else [])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(digest, DIGEST)
