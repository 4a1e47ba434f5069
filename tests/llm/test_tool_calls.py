"""Linking, order, validation and serialisation on conversations with tool calls."""
import json

from cardlens.llm import tool_calls as tc

TOOLS = json.dumps({"tools": [{"name": "sum", "parameters": {"type": "object", "required": ["a"], "additionalProperties": False,
                                                            "properties": {"a": {"type": "integer"}, "b": {"type": "string", "enum": ["x", "y"]}}}},
                              {"name": "any", "parameters": None}]})


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def one(i, name="any", args=None, **more):
    return {"id": i, "name": name, "arguments": {} if args is None else args, **more}


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "system", TOOLS), (1, 1, "user", "Hé {\"not\": json"),
    (1, 2, "assistant", call(one("c2", "sum", '{"b":"x", "a":1}', depends_on=["c1", "gone"]), one("c1", "sum", {"a": True, "b": "z", "q": 0}), content="let me")),
    (1, 3, "tool", result("c1", {"z": 1, "a": [2, None]})), (1, 4, "tool", result("c2", "done")), (1, 5, "tool", result("c2", "again")),
    (1, 6, "tool", result("nobody", 1)), (1, 7, "assistant", call(one("c1", "nope"))), (1, 8, "assistant", call(one("c9", "nope"), one(None))),
    (2, 0, "assistant", call(one("a", "any", depends_on=["b"]), one("b", "any", depends_on=["a"]), one("s", "any", [1]))),
    (2, 1, "tool", result("a", None)), (2, 0, "tool", "no json"), (2, 9, "tool", '{"tool_call_id": 5}'), (2, 9, "assistant", '{"tool_calls": "x"}'),
    (3, 0, "tool", result("late", 1)), (3, 1, "assistant", call(one("late"))),
    (None, None, None, None), (None, 0, "assistant", call(one("n"))), (None, 1, "tool", result("n", "v")), (4, 0, "user", ""), (4, 0, "user", ""),
    (5, 0, "system", TOOLS), (5, 1, "assistant", call(one("r", "any"))), (5, 1, "assistant", call(one("r", "any"))), (5, 2, "tool", result("r", 1)), (5, 2, "tool", result("r", 1)),
    (6, 0, "assistant", call(*[one(f"k{i}", "any", depends_on=[f"k{i + 1}"]) for i in range(5)], one("k5"))),
]


def run(spark, rows=ROWS):
    frame = spark.createDataFrame([(*r, 0, "c") for r in rows], "conv_id long, turn long, role string, text string, at int, conv string")
    order = lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["at"], r["level"], r["seq"], r["part"], r["turn"], r["status"])
    return sorted(tc.link(frame).collect(), key=order)


def test_linking(spark):
    rows = run(spark)
    got = [(r["conv_id"], r["kind"], r["call_id"], r["status"]) for r in rows if r["kind"] != "message"]
    one_ = [g[1:] for g in got if g[0] == 1]
    assert one_ == [
        ("call", "c1", "type of a,unexpected q,value of b"), ("result", "c1", "ok"), ("call", "c2", "ok"), ("result", "c2", "ok"), ("result", "c2", "repeated"),
        ("result", "nobody", "orphan"), ("call", "c1", "repeated"), ("call", "c9", "unknown tool,unanswered"), ("call", None, "no id")]
    two = {g[2]: g[3] for g in got if g[0] == 2 and g[1] == "call"}
    assert two == {"a": "circular", "b": "circular,unanswered", "s": "unknown tool,unanswered"}
    assert [g[1:] for g in got if g[0] == 3] == [("result", "late", "orphan"), ("call", "late", "unknown tool,unanswered")]
    assert [g[1:] for g in got if g[0] is None] == [("call", "n", "unknown tool"), ("result", "n", "ok")]
    assert sorted(g[1:] for g in got if g[0] == 5) == [("call", "r", "ok"), ("call", "r", "repeated"), ("result", "r", "ok"), ("result", "r", "repeated")]
    assert [g[2] for g in got if g[0] == 6] == ["k5", "k4", "k3", "k2", "k1", "k0"]
    assert len([r for r in rows if r["kind"] == "message"]) == 10


def test_lines_are_canonical(spark):
    for r in run(spark):
        value = json.loads(r["line"])
        assert r["line"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    lines = [r["line"] for r in run(spark)]
    assert '{"arguments":{"a":1,"b":"x"},"id":"c2","name":"sum","role":"call"}' in lines
    assert '{"content":{"a":[2,null],"z":1},"id":"c1","role":"result"}' in lines
    assert '{"content":"Hé {\\"not\\": json","role":"user"}' in lines and '{"content":null,"role":null}' in lines


def test_empty(spark):
    assert run(spark, []) == []
