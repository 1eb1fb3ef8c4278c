import json
import os

import pytest
from strandline.operators import nested as N


def brute(o):
    out = [("$", "")]

    def obj(v, p):
        if isinstance(v, dict):
            if v.get("mFrame") is not None:
                out.append((p + "/frame", p))
            for key, c in (("mDetectedObjectMetadatas", "d"), ("mSubObjectMetadatas", "s")):
                if isinstance(v.get(key), list):
                    for i, x in enumerate(v[key]):
                        if x is None:
                            continue
                        out.append((f"{p}/{c}{i}", p))
                        if c == "s":
                            obj(x, f"{p}/s{i}")
                        elif isinstance(x, dict) and x.get("mBox") is not None:
                            out.append((f"{p}/d{i}/box", f"{p}/d{i}"))

    obj(o, "$")
    return sorted(out)


CASES = [
    {}, {"mFrame": None}, {"mFrame": {"mWidth": 3}}, {"mFrame": "x", "mDetectedObjectMetadatas": {"mBox": 1}},
    {"mDetectedObjectMetadatas": [None, {}, {"mBox": None}, {"mBox": [1, 2]}, 7]},
    {"mSubObjectMetadatas": [None, {"mSubObjectMetadatas": [{"mFrame": {}}], "mDetectedObjectMetadatas": [{"mBox": {"mX": 1}}]}]},
]


@pytest.mark.parametrize("o", CASES)
def test_visit_equals_recursion(o):
    assert sorted((p, q) for _, p, q, _ in N.visit(o)) == brute(o)
    assert N.parse_deep(json.dumps(o)) == o


def test_deep_nesting():
    depth = 20_000
    text = '{"mSubObjectMetadatas":[' * depth + "{}" + "]}" * depth
    assert sum(1 for _ in N.visit(N.read_payload(text))) == depth + 1


@pytest.mark.parametrize("text", [None, "", "  ", "[]", "null", "3", '"x"', "{", '{"a":1}]', '{"a":NaN}', '{"a":1,}', "connection reset"])
def test_no_object(text):
    assert N.read_payload(text) is None


def test_wrapping():
    assert N.read_payload("﻿ \n" + json.dumps(json.dumps("﻿" + json.dumps({"a": 1})))) == {"a": 1}
    assert N.read_payload('{"a":1,"a":2}') == {"a": 2}


def test_emission_and_tables(spark, tmp_path):
    rows = [(i, json.dumps(o), "clash", "clash") for i, o in enumerate(CASES)] + [(None, "{}", "", ""), (99, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, payload string, node_path string, tag string")
    got = {(r.record_id, r.node_path, r.parent_path) for r in N.emit_nodes(df).collect()}
    assert got == {(i, p, q) for i, o in enumerate(CASES) for p, q in brute(o)} | {(None, "$", "")}
    N.flatten_to(df, str(tmp_path / "t"))
    assert {f for f in os.listdir(tmp_path / "t") if f.startswith("tag=")} == {"tag=object", "tag=sub_object", "tag=detection", "tag=frame", "tag=box"}
    boxes = N.typed_table(N.emit_nodes(df), N.BOX).collect()
    assert [r.mX for r in boxes if r.record_id == 5] == [1]
    assert N.emit_nodes(df.limit(0)).count() == 0
