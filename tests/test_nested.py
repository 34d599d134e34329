import json
import os

import pytest

from seamquarry.operators import nested as N

TEXTS = {
    "a": json.dumps({"runs": [{"results": [{"m": {"t": 1}}, None, {"x": [[{"y": 2}]]}]}, 5], "z": {"q": "s"}}),
    "b": "﻿" + json.dumps([{"a": 1}, [], {}]),
    "c": json.dumps(json.dumps({"l": [{"k": "ü"}]})),
    "d": '{"l": [{"k": 1}',
    "e": "",
    "f": None,
    "g": '{"l": [NaN, {"a": 1}]}',
    "h": '"just text"',
    "i": '{"l": [{"\\ud800": [{"n": 1}]}]}',
    "j": json.dumps(json.dumps({"l": [{"k": 1}]})).replace("[", "\\u005b"),
}
WANT = {
    ("a", "runs[0]"), ("a", "runs[0].results[0]"), ("a", "runs[0].results[2]"), ("a", "runs[0].results[2].x[0][0]"),
    ("b", "[0]"), ("b", "[2]"), ("c", "l[0]"), ("i", "l[0]"), ("i", "l[0].?[0]"), ("j", "l[0]"),
}


def texts(spark):
    rows = [("runlog", k, v, "extra") for k, v in TEXTS.items()]
    return spark.createDataFrame(rows + rows[:3], "origin string, record_key string, text string, path string")


def test_elements(spark):
    rows = N.array_elements(texts(spark)).collect()
    assert {(r.record_key, r.child_path) for r in rows} == WANT and len(rows) == len(WANT)


def test_tables_link_to_parents(spark):
    rows = N.flatten(texts(spark).where("text is not null")).collect()
    keys = {(r.record_key, r.path) for r in rows}
    for r in rows:
        if r.tag == "#broken":
            assert r.record_key in "degh"
        elif r.parent_path is not None:
            assert (r.record_key, r.parent_path) in keys and r.path.startswith(r.parent_path)
    assert {(r.record_key, r.path) for r in rows if r.in_array} == WANT
    assert json.loads(next(r.payload for r in rows if (r.record_key, r.path) == ("a", "z"))) == {"q": "s"}


def test_long_numbers_and_depth(spark):
    deep = "[" * 50_000 + "]" * 50_000
    df = spark.createDataFrame([("x", "1", '[{"n": ' + "9" * 6000 + "}]"), ("x", "2", deep)], "origin string, record_key string, text string")
    assert [(r.record_key, r.child_path) for r in N.array_elements(df).collect()] == [("1", "[0]")]
    assert N.array_elements(df.limit(0)).count() == 0


def test_typed_tables_by_tag(spark, tmp_path):
    docs = [{"n": 1, "s": "a", "mix": 1, "Id": 1, "id": 2, "path": "p", "none": None, "items": [{"x": 1.5, "tags": ["u", "v"]}, {"x": 2}]}, {"n": 2**40, "mix": "m", "items": []}, {"n": None}]
    df = spark.createDataFrame([("o", str(i), json.dumps(x)) for i, x in enumerate(docs)] + [("o", "9", "{")], "origin string, record_key string, text string")
    at = f"{tmp_path}/tables"
    N.write_tables(N.flatten(df), at)
    assert len([x for x in os.listdir(at) if x.startswith("part=")]) == 3  # the top objects, the items, the broken text
    top = N.read_table(spark, at, "")
    kinds = dict(top.dtypes)
    assert (kinds["n"], kinds["s"], kinds["mix"], kinds["none"], kinds["Id"], kinds["id_2"], kinds["path_2"]) == ("bigint", "string", "string", "string", "bigint", "bigint", "string")
    got = {r.record_key: r for r in top.collect()}
    assert [got[k].n for k in "012"] == [1, 2**40, None] and [got[k].mix for k in "012"] == ["1", "m", None] and (got["0"].Id, got["0"].id_2, got["0"].path_2) == (1, 2, "p")
    items = N.read_table(spark, at, "items[]")
    assert {(r.record_key, r.path, r.parent_path, float(r.x)) for r in items.collect()} == {("0", "items[0]", "", 1.5), ("0", "items[1]", "", 2.0)}
    assert dict(items.dtypes)["tags"] == "array<string>" and {(r.path, r.position, r.value) for r in N.read_array(spark, at, "items[]", "tags").collect()} == {("items[0]", 0, "u"), ("items[0]", 1, "v")}
    assert N.read_table(spark, at, "#broken").columns == ["origin", "record_key", "path", "parent_path", "in_array"] and N.read_table(spark, at, "nowhere").count() == 0


def test_any_depth_is_read(spark):
    deep = '{"a": [' * 60_000 + '{"k": [1, "x", -2.5e3, true, null, {}]}' + "]}" * 60_000
    inner = N.whole_json(deep)
    for _ in range(60_000):
        inner = inner["a"][0]
    assert inner == {"k": [1, "x", -2500.0, True, None, {}]}
    lists = spark.createDataFrame([("o", "k", "[" * 50_000 + '{"a": 1}' + "]" * 50_000)], "origin string, record_key string, text string")
    assert N.array_elements(lists).first().child_path == "[0]" * 50_000


def test_deep_parser_takes_what_the_plain_one_takes():
    good = ['{"a": {"b": [1, [], {}, "x\\n", null]}, "c": 0}', " [ ] ", "{}", '"s"', "5", "[1,2 ,3]", '{"a":1,"a":2}']
    bad = ["", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "[1}", '{"a":1]', "[", "]", "[1]]", "1 2", "nul", "01", "[,1]", '{"a":1,}', '{1:2}', "'x'"]
    assert all(N.deep_json(t) == json.loads(t) for t in good)
    for t in bad:
        with pytest.raises(ValueError):
            N.deep_json(t)
