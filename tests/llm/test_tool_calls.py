import json

from pyspark.sql import functions as F

from talentlake.llm.tool_calls import SCHEMAS, call_levels, calls_of, link_calls, message_lines

CALL = "conv_id bigint, call_id string, seq bigint, name string, arguments string, depends_on array<string>"
RESULT = "conv_id bigint, call_id string, seq bigint, content string"
TOOLS = {"get": {"properties": {"key": {"type": "string", "minLength": 2, "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9},
                                "mode": {"type": "string", "enum": ["a", "b"]}, "x": {"type": "number"}, "o": {"type": "object"},
                                "l": {"type": "array"}, "f": {"type": "boolean"}},
                 "required": ["key"], "additionalProperties": False}, "any": {}}


def errors(spark, *arguments, name="get"):
    calls = spark.createDataFrame([(1, str(i), i, name, a, []) for i, a in enumerate(arguments)], CALL)
    return [r.errors for r in link_calls(calls, spark.createDataFrame([], RESULT), TOOLS).orderBy("seq").collect()]


def test_arguments_are_validated(spark):
    assert errors(spark, '{"key":"abc"}', '{"key":"abc","n":3,"mode":"a","x":1.5,"o":{},"l":[],"f":true}', '{"n":1}', '{"key":5}', '{"key":"a"}',
                  '{"key":"abcdef"}', '{"key":"ab","n":0}', '{"key":"ab","n":10}', '{"key":"ab","n":1.5}', '{"key":"ab","mode":"c"}',
                  '{"key":"ab","z":1}', '[1]', 'oops', None, '{"key":"ab","x":"1","o":[],"l":{},"f":0}') == [
        [], [], ["key: missing"], ["key: not of type string", "key: too short"], ["key: too short"], ["key: too long"], ["n: too small"],
        ["n: too large"], ["n: not of type integer"], ["mode: not one of the values"], ["unknown argument"],
        *[["arguments are no object"]] * 3,
        ["f: not of type boolean", "l: not of type array", "o: not of type object", "x: not of type number"]]
    assert errors(spark, '{}', name="any") == [[]] and errors(spark, '{}', name="other") == [["unknown tool"]] == errors(spark, '{}', name=None)


def test_levels_follow_dependencies(spark):
    rows = [(1, "d", ["b", "c"]), (1, "b", ["a"]), (1, "c", ["b"]), (1, "a", []), (1, "x", ["y"]), (1, "y", ["x"]), (1, "z", ["y", "a"]),
            (1, "s", ["s", "unknown"]), (2, "a", ["b"]), (2, "b", None), (2, "b", ["b2"]), (2, "b2", []), (None, "q", []), (2, None, ["a"])]
    calls = spark.createDataFrame([(c, i, 0, "any", "{}", d) for c, i, d in rows], CALL)
    assert {(r.conv_id, r.call_id): r.level for r in call_levels(calls).collect()} == {
        (1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (1, "s"): 0, (2, "b2"): 0, (2, "b"): 1, (2, "a"): 2}


def test_levels_of_long_chains_and_where_they_meet(spark):
    """200 calls in a row, two rows of 30 that meet, a cycle of 7 with a chain of 5 behind it."""
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(200)]
    rows += [(2, f"{s}{i}", [f"{s}{i - 1}"] if i else []) for s in "ab" for i in range(30)] + [(2, "m", ["a29", "b7", "a3"]), (2, "m1", ["m"]), (2, "m2", ["m1", "b29"])]
    rows += [(3, f"o{i}", [f"o{(i + 1) % 7}"]) for i in range(7)] + [(3, f"p{i}", [f"p{i - 1}" if i else "o0"]) for i in range(5)] + [(3, "q", ["p4", "f"]), (3, "f", [])]
    calls = spark.createDataFrame([(c, i, 0, "any", "{}", d) for c, i, d in rows], CALL)
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(calls).collect()}
    assert got == {(1, f"c{i}"): i for i in range(200)} | {(2, f"{s}{i}"): i for s in "ab" for i in range(30)} | {
        (2, "m"): 30, (2, "m1"): 31, (2, "m2"): 32, (3, "f"): 0}


def test_links_and_canonical_json(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "any", ' { "b" : [1, {"z":1,"y":"\\u00e9\\n"}], "a":"q\\"" } ', []), (1, "a", 5, "any", "{}", []), (1, "b", 1, "any", "[]", None),
        (None, "a", 2, "any", "{}", []), (1, None, 3, "any", "{}", []), (2, "a", 0, "any", "{}", ["a"])], CALL)
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 4, "first"), (1, "c", 4, "stray"), (1, None, 4, None), (2, "a", 1, None)], RESULT)
    got = link_calls(calls, results, TOOLS).collect()
    assert len(got) == len([*calls.collect()]) + 3
    lines = {(r.conv_id, r.call_id, r.seq, r.kind): r for r in got}
    first = lines[1, "a", 0, "call"]
    assert first.record == '{"arguments":{"a":"q\\"","b":[1,{"y":"é\\n","z":1}]},"id":"a","name":"any","result":"first"}' and first.linked
    assert lines[1, "a", 5, "call"].linked and json.loads(lines[1, "b", 1, "call"].record)["arguments"] is None
    assert lines[2, "a", 0, "call"].linked and lines[2, "a", 0, "call"].record.endswith('"result":null}')
    assert not lines[None, "a", 2, "call"].linked and lines[1, None, 3, "call"].level == 0
    assert {(k[1], k[2]) for k in lines if k[3] == "result"} == {("a", 9), ("c", 4), (None, 4)}
    assert lines[1, "c", 4, "result"].record == '{"id":"c","result":"stray"}'


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "a question of some length"),
                                   (2, 0, "assistant", None), (2, 1, None, None), (3, None, "user", None), (None, 1, "user", "x" * 100_000)],
                                  "conv_id bigint, turn bigint, role string, text string")
    calls, results = calls_of(turns)
    got = {(r.conv_id, r.seq, r.kind): r for r in link_calls(calls, results, SCHEMAS).collect()}
    assert len(got) == 5
    assert got[1, 1, "call"].linked and got[1, 1, "call"].errors == [] and got[1, 3, "call"].level == 1 and got[1, 3, "call"].errors == []
    assert got[3, None, "call"].errors == ["prompt: not of type string", "turn: not of type integer"] and got[2, 0, "result"].record.endswith("null}")
    others = message_lines(turns.filter("coalesce(role, '') NOT IN ('user', 'assistant')"))
    assert sorted(r.record for r in others.collect()) == ['{"content":"s","role":"system"}', '{"content":null,"role":null}']
    empty = turns.limit(0)
    assert link_calls(*calls_of(empty), SCHEMAS).count() == 0


def test_clashing_columns_are_not_read(spark):
    calls = spark.createDataFrame([(1, "a", 0, "any", "{}", []), (1, "b", 1, "any", "{}", ["a"])], CALL)
    results = spark.createDataFrame([(1, "a", 1, "done"), (1, "z", 2, "spare")], RESULT)
    names = ["level", "result", "args", "result_seq", "linked", "errors", "record", "kind", "up", "off", "n"]
    clash = {n: F.lit("x") for n in names}
    want = sorted(map(tuple, link_calls(calls, results, TOOLS).collect()), key=repr)
    assert sorted(map(tuple, link_calls(calls.withColumns(clash), results.withColumns(clash), TOOLS).collect()), key=repr) == want
    assert len(want) == 3
