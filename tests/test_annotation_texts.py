"""Annotations written for every 4000 characters of a text, and read back."""

from __future__ import annotations

import duckdb
import pytest

from inspectra.plans import registry, views
from tests.conftest import plain

TEXTS = [(1, 'a"b\\c\nd\t\x01é\U0001f600€/' * 900), (2, ""), (3, None), (4, "x"), (5, " " * 4000), (6, "z" * 8001)]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["s3_p5_m5_read_annotations", "p6_labelled_items", "s7_csv_round_trip"])
def test_odd_characters_as_sql(name, spark, odd_texts):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_texts}/documents.parquet/*.parquet'")
    result = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    ours = registry.queries()[name](spark, odd_texts).select(*columns).collect()
    assert sorted(repr(plain(tuple(r))) for r in ours) == sorted(repr(plain(r)) for r in result.fetchall())


def test_texts_hold_at_most_so_many_items_and_only_wanted_keys_are_read(spark, odd_texts):
    from inspectra.operators import geometry

    texts = views.annotation_texts(spark, odd_texts, lambda ch, kind: {"ch": ch, "label": None if kind else "L"}, lambda idx: {"idx": idx, "w": 1.5}, "﻿", size=3000)
    rows = geometry.read_annotations(texts, item="array<struct<ch:string,idx:int,label:string>>")
    assert rows.schema["item"].dataType.names == ["ch", "idx", "label"] and texts.where("json LIKE '﻿{%' AND json NOT LIKE '%null%'").count() == 4 + 1 + 2 + 3
    got = {}
    for r in rows.collect():
        assert (r.item.label == "L") == (r.item.idx % 5 == 0)
        got.setdefault(int(r.image_name[:-4]), {})[r.item.idx] = r.item.ch
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()} == {k: t for k, t in TEXTS if t}


def test_csv_values_may_hold_line_breaks(spark, tmp_path):
    from inspectra.sources import files

    rows = [(1, 'a\nb,"c"', 1.5), (2, "\r\n", None), (3, None, 2.0), (4, "plain", -1.0)]
    files.write_csv(spark.createDataFrame(rows, "id long, s string, v double").repartition(3), f"{tmp_path}/c", "gzip")
    got = {r.id: (r.s, r.v) for r in files.read_csv(spark, f"{tmp_path}/c", "id long, s string, v double").collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == ('a\nb,"c"', 1.5) and got[3] == (None, 2.0) and got[4] == ("plain", -1.0) and got[2][1] is None
