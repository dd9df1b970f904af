"""Records with further fields of any depth, and records that no layout fits."""

from __future__ import annotations

import json

from inspectra.llm import chat


def deep(levels):
    out = {"role": "no", "x": 1}
    for k in range(levels):
        out = {"inner": out, f"list{k}": [[{"a": [[1]]}], [], [[[]]]]}
    return out


def test_further_fields_of_any_depth(spark):
    said = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]
    records = {
        1: {"messages": said, "meta": deep(9)},
        2: {"messages": [said[0] | {"meta": deep(7), "name": None}, said[1] | {"calls": [[1], [[2]]]}]},
        3: {"prompt": "p", "response": "r", "tags": [[[1]]], "messages_": [], "deep": [[{"a": [{"b": [{"c": [{}]}]}]}]]},
        4: {"conversations": [{"from": "human", "value": "v", "w": {"a": {"b": {"c": {"d": {"e": {}}}}}}}]},
        5: {"turn": 3, "role": "user", "text": "t", "instructions": {"output": [1]}},
        6: {"messages": [], "meta": deep(5)},
        7: {"instruction": "i", "output": None, "role_": []},
    }
    df = spark.createDataFrame([(json.dumps({"conv_id": k} | r),) for k, r in records.items()], "record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect() if r.text is not None)
    pair = lambda k: [(k, 0, "user", "hi"), (k, 1, "assistant", "ho")]
    assert got == [*pair(1), *pair(2), (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", "v"), (5, 3, "user", "t"), (7, 0, "user", "i")]
    assert chat.unknown_layouts(df).isEmpty()


def test_what_no_layout_fits_is_counted(spark):
    bad = [
        {"messages": [{"role": "user", "content": "no id"}]}, {"messages": [{"role": "user", "content": "nor here"}]},
        {"conv_id": 1, "messages": [{"role": "user", "content": [{"type": "text", "text": "parts"}]}]}, {"conv_id": 2, "messages": "text"},
        {"conv_id": 3, "messages": [1, 2]}, {"conv_id": 4, "prompt": {"a": 1}, "response": "r"}, {"conv_id": 5, "other": 1}, [1], "text", None,
    ]
    df = spark.createDataFrame([(None if r is None else json.dumps(r),) for r in bad] + [("{broken",)], "record string")
    assert chat.canonical_turns(df).isEmpty()
    rejected = chat.unknown_layouts(df).collect()
    assert sum(r.records for r in rejected) == len(bad) + 1
    assert {2} <= {r.records for r in rejected}


def test_a_whole_conversation_reads_back(spark):
    said = "</s>[INST] \\ <s> [/INST]"
    df = spark.createDataFrame([(json.dumps({"conv_id": 1, "messages": [{"role": r, "content": said + r} for r in ("system", "user", "assistant", "tool <|text|>")]}),)], "record string")
    segments = [r.segment for r in chat.format_turns(chat.canonical_turns(df)).orderBy("turn").collect()]
    assert chat.parse_conversation("".join(segments)) == [(r, said + r) for r in ("system", "user", "assistant", "tool <|text|>")]
