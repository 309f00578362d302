import json

from lexiloom.llm import chat


def test_linking(spark):
    calls = [(1, 0, "a", None, "add", '{"y": 2, "x": 1}'), (1, 2, "b", "a", "add", '{"x": "1"}'), (1, 4, "c", "b", "find", "[1]"), (1, 5, "c", "a", "later", "{}")]
    calls += [(2, 0, "a", "b", "add", '{"x": 1, "y": null, "z": {"b": [1, 2.50], "a": "é"}}'), (2, 1, "b", "a", "add", "nonsense"), (2, 2, None, None, "add", "{}"), (None, 2, "a", None, "add", None)]
    calls += [(3, 0, "x", "gone", "other", None)] + [(4, k, f"n{k}", f"n{k - 1}", "add", '{"x": 1, "y": 2}') for k in range(40)]
    results = [(1, 1, "a", "3"), (1, 9, "a", "4"), (1, 3, "zz", "?"), (2, 3, "a", None), (None, 1, "a", "x")]
    schemas = [("add", [("x", "integer", True), ("y", "number", True)]), ("find", [("q", "string", False)])]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, after_id string, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    s = spark.createDataFrame(schemas, "name string, fields array<struct<name:string,type:string,required:boolean>>")
    found = {(x.conv_id, x.call_id): x for x in chat.linked(c, r, s).collect()}
    assert len(found) == 47
    brief = {k: (v.level, v.status, v.errors) for k, v in found.items() if k[0] != 4}
    assert brief == {
        (1, "a"): (0, "linked", ""), (1, "b"): (1, "pending", "missing:y,type:x"), (1, "c"): (2, "pending", "invalid"), (1, "zz"): (None, "orphan", None),
        (2, "a"): (None, "linked", "type:y,unknown:z"), (2, "b"): (None, "pending", "invalid"), (3, "x"): (0, "pending", "no schema"),
    }
    assert [found[4, f"n{k}"].level for k in range(40)] == list(range(40))
    assert found[1, "a"].record == '{"arguments":{"x":1,"y":2},"conversation":1,"errors":[],"id":"a","level":0,"name":"add","result":"3","status":"linked"}'
    assert '{"x":1,"y":null,"z":{"a":"é","b":[1,2.5]}}' in found[2, "a"].record
    assert all(json.loads(x.record)["status"] == x.status for x in found.values())
    assert chat.linked(c.limit(0), r.limit(0), s.limit(0)).count() == 0
