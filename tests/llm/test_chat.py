import json
import random

import pytest

from sightline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mid string, calls string"
WEATHER = {"type": "object", "properties": {"city": {"type": "string", "minLength": 2}, "days": {"type": "integer", "maximum": 5}}, "required": ["city"], "additionalProperties": False}


def call(i, name="weather", args=None, needs=()):
    return {"id": i, "name": name, "arguments": {"city": "Rome"} if args is None else args} | ({"depends_on": list(needs)} if needs else {})


def conversation():
    return [
        (1, 0, "system", json.dumps({"content": "hi", "tools": [{"name": "weather", "parameters": WEATHER}]})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("a"), call("b", args={"days": 9.0})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "sun"})),  # logged before its call
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c", needs=["a"])]})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c", "content": {"z": 1.0, "a": [2.5]}})),
        (1, 7, "tool", json.dumps({"tool_call_id": "c", "content": "again"})),
        (1, 8, "tool", json.dumps({"tool_call_id": "nobody"})),
        (1, 9, "user", "{not json"),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", needs=["y"])]})),
        (2, 1, "tool", json.dumps({"tool_call_id": "x"})),
        (2, 2, "assistant", json.dumps({"tool_calls": [call("y", needs=["x"])]})),
        (2, 3, "tool", json.dumps({"tool_call_id": "y"})),
        (3, 0, "user", None), (3, 0, "user", None), (None, None, "tool", json.dumps({"tool_call_id": "a"})), (3, 1, "user", "word " * 20_000), (3, 2, "user", ""),
    ]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in conversation()], SCHEMA)


def check(rows):
    by = {(r.conv_id, r.turn): r for r in rows if r.conv_id is not None}
    assert len(rows) == len(conversation())
    assert (by[1, 5].n_calls, by[1, 5].n_linked, by[1, 5].n_invalid) == (2, 1, 1)
    assert [by[1, t].link for t in (2, 6, 7, 8)] == ["linked", "linked", "duplicate", "orphan"]
    order = [t for c, t in sorted(by, key=lambda k: (by[k].order_turn, by[k].order_level, k[1])) if c == 1]
    assert order.index(5) < order.index(2) < order.index(3) < order.index(6)
    assert all(by[2, t].in_cycle for t in range(4)) and not by[1, 3].in_cycle
    assert by[1, 6].json == '{"content":"{\\"a\\":[2.5],\\"z\\":1}","role":"tool","tool_call_id":"c"}'
    assert json.loads(by[1, 5].json)["tool_calls"][0] == {"id": "a", "name": "weather", "arguments": {"city": "Rome"}, "result": "sun", "valid": True}
    assert json.loads(by[1, 9].json)["content"] == "{not json" and json.loads(by[3, 0].json)["content"] is None


def test_links_order_and_json(messages):
    check(chat.formatted(messages).collect())


def test_large_conversations_go_in_rounds(messages, monkeypatch):
    monkeypatch.setattr(chat, "LOCAL_EDGES", 0)
    check(chat.formatted(messages).collect())


def test_common_schemas_and_empty(spark, messages):
    schemas = spark.createDataFrame([("weather", "false")], "name string, schema string")
    rows = chat.formatted(messages.filter("conv_id = 2"), schemas).collect()
    assert sum(r.n_invalid for r in rows) == 2
    assert chat.formatted(messages.limit(0)).collect() == []


@pytest.mark.parametrize(("value", "schema", "wrong"), [
    (1, {"type": "integer"}, 0), (1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), ("a", {"type": ["string", "null"]}, 0), ("a", {"enum": ["b"]}, 1),
    ([1, "x"], {"items": {"type": "number"}}, 1), ({"a": 1}, {"required": ["a", "b"]}, 1), ({"a": 1}, {"additionalProperties": False}, 1), (3, {"minimum": 4}, 1),
    ("abc", {"pattern": "^b"}, 1), ("abc", {"maxLength": 2}, 1), (1, {"anyOf": [{"type": "string"}, {"const": 1}]}, 0), (1, {"allOf": [{"maximum": 0}]}, 1), (1, False, 1),
])
def test_schemas(value, schema, wrong):
    assert len(chat.errors(value, schema)) == wrong


def test_canonical():
    assert chat.canonical({"b": 1.0, "a": [None, True, "é", 1e-7, 2.50]}) == '{"a":[null,true,"é",1e-07,2.5],"b":1}'
    assert chat.canonical(json.loads(chat.canonical({"x": {"z": 1, "y": 2}}))) == '{"x":{"y":2,"z":1}}'


def test_topological_against_definition():
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)]
    got = {n: (t, lv, c) for n, t, lv, c in chat.topological(edges, {k: 10 - k for k in range(1, 7)})}
    assert got[1] == (9, 0, False) and got[2] == (9, 1, False) and got[3] == (9, 2, False)
    assert all(got[n][2] for n in (4, 5, 6))


DEEP = "[" * 2000 + "]" * 2000
ODD = [
    '{"tool_calls": 5}', '{"tools": 1}', '{"content": "\\ud800"}', '{"content": ' + DEEP + "}", json.dumps({"tool_calls": [{"id": "d", "name": "t", "arguments": DEEP}]}),
    '{"tool_calls": [{"id": "n", "name": "t", "arguments": {"x": ' + "9" * 400 + "}}]}", '{"tool_calls": [{"arguments": {"x": ' + "9" * 5000 + "}}]}",
    '{"tool_calls": [{"id": "s", "name": "\\udfff", "arguments": "\\ud800"}], "tools": [{"name": "t", "parameters": {"properties": {"x": {"type": "integer", "maximum": 5}}}}]}',
    '{"tool_calls": [null, 3, [], {"depends_on": "x"}, {"depends_on": [1, null, {}]}, {"name": {"a": 1}, "id": 1.0}]}', '{"tool_call_id": {"a": []}}', '{"tool_calls": {}, "content": 1e999}',
]


def test_malformed_messages_do_not_fail(spark):
    rows = spark.createDataFrame([(1, k, "assistant", t, "x", "y") for k, t in enumerate(ODD)], SCHEMA)
    got = {r.turn: r for r in chat.formatted(rows).collect()}
    assert len(got) == len(ODD) and all(json.loads(r.json)["role"] == "assistant" for r in got.values())
    assert json.loads(got[2].json)["content"] == "\ufffd" and json.loads(got[3].json)["content"] == ODD[3]
    assert json.loads(got[4].json)["tool_calls"][0]["arguments"] == DEEP
    assert (got[5].n_invalid, got[6].n_calls, got[7].n_unchecked, got[8].n_calls) == (1, 0, 1, 3)


@pytest.mark.parametrize("schema", [
    {"pattern": "("}, {"pattern": "(?=x)"}, {"enum": 1}, {"required": 3}, {"allOf": {}}, {"minimum": "a"}, {"properties": []}, {"type": [{}]}, {"type": "text"}, {"$ref": "#/x"}, {"minLength": None}, {"multipleOf": 0}, [], "x", 3,
])
def test_what_is_not_checked(schema):
    for value in ("aaaa", 7):
        try:
            chat.errors(value, schema)
        except chat.Unchecked:
            break
    else:
        raise AssertionError
    assert chat.checked('"aaaa"', "{no json")[0] is None


@pytest.mark.parametrize(("value", "schema", "wrong"), [
    (5, {"exclusiveMinimum": 5}, 1), (5, {"exclusiveMaximum": 6}, 0), (0.3, {"multipleOf": 0.1}, 0), (7, {"multipleOf": 2}, 1), ([1, 1.0], {"uniqueItems": True}, 1), (1, {"oneOf": [{}, {}]}, 1), (1, {"not": {"type": "string"}}, 0),
    ({"ab": 1, "c": 1}, {"patternProperties": {"^a": {"type": "string"}}, "additionalProperties": False}, 2), (10**400, {"type": "integer", "minimum": 0}, 0), ("a" * 40 + "!", {"pattern": "^(a+)+$"}, 1), ({}, {"minProperties": 1}, 1),
])
def test_more_schemas(value, schema, wrong):
    assert len(chat.errors(value, schema)) == wrong


def test_links_against_brute_force(spark):
    """Random calls, results and dependencies; half of them in one conversation."""
    rng = random.Random(2)
    rows = []
    for turn in range(600):
        conv = rng.choice([1, 1, 1, 2, 3])
        ident = lambda: f"c{rng.randrange(150)}"
        kind = rng.random()
        if kind < 0.45:
            text = json.dumps({"tool_calls": [call(ident(), args={"city": rng.choice(["Rome", "", 3])}, needs=[ident()] if rng.random() < 0.3 else ()) for _ in range(rng.randint(1, 2))]})
        elif kind < 0.9:
            text = json.dumps({"tool_call_id": ident(), "content": str(turn)})
        else:
            text = json.dumps({"content": "x", "tools": [{"name": "weather", "parameters": WEATHER}]})
        rows.append((conv, turn, "assistant", text, "x", "y"))
    calls, results = {}, {}
    for conv, turn, _, text, *_ in rows:
        found = json.loads(text)
        for k, c in enumerate(found.get("tool_calls", [])):
            calls.setdefault((conv, c["id"]), (turn, k))
        if "tool_call_id" in found:
            results.setdefault((conv, found["tool_call_id"]), turn)
    got = {r.turn: r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    schemas = {conv for conv, _, _, text, *_ in rows if "tools" in json.loads(text)}
    for conv, turn, _, text, *_ in rows:
        found, r = json.loads(text), got[turn]
        own = found.get("tool_calls", [])
        linked = [c for k, c in enumerate(own) if calls[conv, c["id"]] == (turn, k) and (conv, c["id"]) in results]
        bad = [c for c in own if conv in schemas and not (isinstance(c["arguments"]["city"], str) and len(c["arguments"]["city"]) >= 2)]
        assert (r.n_calls, r.n_linked, r.n_invalid) == (len(own), len(linked), len(bad))
        key = (conv, found.get("tool_call_id"))
        state = None if key[1] is None else "orphan" if key not in calls else "linked" if results[key] == turn else "duplicate"
        assert r.link == state
        place = lambda t: (got[t].order_turn, got[t].order_level)
        if not r.in_cycle:
            if state == "linked" and calls[key][0] != turn:
                assert place(calls[key][0]) < place(turn)
            for c in own:
                for need in c.get("depends_on", []):
                    if (conv, need) in calls and (conv, need) in results and results[conv, need] != turn:
                        assert place(results[conv, need]) < place(turn)
