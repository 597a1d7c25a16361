"""Bodies in odd shapes: what is read from them, and what is written back."""

import json

import pytest
from pyspark.sql import functions as F

from turnlake.functions import fields as X

BODIES = {
    "mixed": '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"tool_use","name":"Read","input":{"p":1}}],"tool_calls":[{"function":{"name":"f","arguments":"{}"}},{"function":{}}]},'
    '{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":"x"},"y",3]}]},{"role":"tool","name":5,"tool_call_id":"q","content":"res"},{"content":null},{"role":"tool","content":""}]}',
    "chat": '{"choices":[{"message":{"role":"assistant","content":"yo","tool_calls":[{"function":{"name":"g","arguments":"1"}}]},"finish_reason":"stop"},{"text":"old"}]}',
    "blocks": '{"content":[{"type":"text","text":"t"},{"type":"tool_use","input":"s"},{"type":"tool_result","content":""}],"stop_reason":"end"}',
    "stream": 'data: {"choices":[{"delta":{"content":"ab"}}]}\r\n\r\ndata: nonsense\ndata: {"choices":[{"delta":{"content":"c","tool_calls":[{"function":{"name":"z"}},{"index":1}]}}]}\n\ndata: [DONE]',
    "delta": '{"choices":[{"delta":{"tool_calls":[{"function":{"arguments":"q"}}]}}]}',
    "words": "no body", "list": "[1]", "null": None, "empty": "", "wrong": '{"messages":"x","choices":7,"content":{}}',
}


@pytest.fixture(scope="module")
def read(spark):
    d = spark.createDataFrame(list(BODIES.items()), "k string, body string")
    return {r.k: r for r in d.select("k", X.text_fields("body").alias("f"), X.messages("body").alias("m"), X.response("body").alias("r")).collect()}


def test_text_fields(read):
    short = {k: [(f.pointer, f.msg, f.sub, f.text) for f in r.f or []] for k, r in read.items()}
    assert short["mixed"] == [
        ("message_string", 0, 0, "hi"), ("message_content", 1, 0, "a"), ("tool_arguments", 1, 0, "{}"), ("block", 1, 0, "a"), ("block", 1, 2, '{"p":1}'),
        ("block", 2, 0, '[{"text":"x","type":"text"},"y",3]'), ("message_string", 3, 0, "res"), ("message_string", 5, 0, ""),
    ]
    assert short["chat"] == [("message_string", 0, 0, "yo"), ("tool_arguments", 0, 0, "1"), ("message_string", 0, 0, "old")]
    assert short["blocks"] == [("block", 0, 0, "t"), ("block", 0, 1, '"s"')] and short["delta"] == [("delta_arguments", 0, 0, "q")]
    assert all(short[k] == [] for k in ("words", "list", "null", "empty", "wrong", "stream"))


def test_predicates(read):
    of = {(f.msg, f.pointer, f.sub): (f.tool_related, f.tool_result, f.user_authored, f.model_input, f.ops) for f in read["mixed"].f}
    assert of[0, "message_string", 0] == (False, False, True, True, True) and of[1, "block", 2] == (True, False, False, False, True)
    assert of[2, "block", 0] == (True, True, False, True, True) and of[3, "message_string", 0] == (False, True, False, True, False)
    assert [f.model_input for f in read["blocks"].f] == [False, False] and [f.model_input for f in read["delta"].f] == [False]


def test_messages(read):
    m = [(x.role, x.text, [tuple(c) for c in x.tool_calls], [tuple(c) for c in x.tool_results]) for x in read["mixed"].m]
    assert m == [
        ("user", "hi", [], []), ("assistant", "a", [("Read", '{"p":1}')], []), ("user", "", [], [("t1", "x\ny")]), ("tool", "res", [], [("tool", "res")]), ("unknown", "", [], []), ("tool", "", [], [("tool", "")]),
    ]


def test_responses(read):
    r = {k: (v.r.text, [tuple(c) for c in v.r.tool_calls or []], v.r.finish) for k, v in read.items()}
    assert r["chat"] == ("yo", [("g", "1")], "stop") and r["blocks"] == ("t", [("tool", '"s"')], "end") and r["stream"] == ("abc", [("z", "")], None)
    assert all(r[k][:2] == ("", []) for k in ("words", "list", "empty", "wrong", "delta", "mixed"))


def test_injection(spark):
    def new(body, *changes, is_response=False):
        d = spark.createDataFrame([(1, body, list(changes))], f"k int, body string, r {X.REPLACEMENTS}")
        out = X.inject(d, "body", "r", is_response)
        assert out.columns == ["k", "body"]
        return out.first().body

    got = json.loads(new(BODIES["mixed"], ("message_string", 0, 0, "HI"), ("block", 1, 2, '{"p":2}'), ("tool_arguments", 1, 0, "x"), ("block", 2, 0, "gone"), ("block", 9, 9, "nowhere"), ("message_content", 1, 0, "é")))
    assert got["messages"][0]["content"] == "HI" and got["messages"][1]["content"][2]["input"] == {"p": 2} and got["messages"][1]["content"][0]["text"] == "é"
    assert got["messages"][1]["tool_calls"][0]["function"]["arguments"] == "x" and got["messages"][2]["content"][0]["content"] == "gone" and got["messages"][3:] == json.loads(BODIES["mixed"])["messages"][3:]
    got = json.loads(new(BODIES["chat"], ("message_string", 0, 0, "no"), ("tool_arguments", 0, 0, "2"), is_response=True))
    assert got["choices"][0]["message"]["content"] == "no" and got["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"] == "2"
    assert json.loads(new(BODIES["blocks"], ("block", 0, 1, "not json"), is_response=True))["content"][1]["input"] == "not json"
    assert json.loads(new(BODIES["delta"], ("delta_arguments", 0, 0, "w")))["choices"][0]["delta"]["tool_calls"][0]["function"]["arguments"] == "w"
    assert new("no body", ("message_string", 0, 0, "x")) == "no body" and new(None, ("message_string", 0, 0, "x")) is None


def test_unchanged_fields_survive(spark):
    d = spark.createDataFrame([(b,) for b in BODIES.values() if b and b[0] == "{"], "body string").withColumn("was", F.col("body"))
    f = d.withColumn("r", F.expr("cast(array() as array<struct<pointer:string,msg:int,sub:int,text:string>>)"))
    assert all(json.loads(r.body) == json.loads(r.was) for r in X.inject(f, "body", "r").collect())
