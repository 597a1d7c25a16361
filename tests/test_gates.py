"""The tool-call gate line by line, paths in tool texts, and session ids against the library's UUIDs."""

import json
import uuid

from pyspark.sql import functions as F

from turnlake.functions import gate, identity, shell


def chunk(**delta):
    return "data: " + json.dumps({"model": "m", "choices": [{"delta": delta}]})


def call(arguments, index=0, **own):
    return chunk(tool_calls=[{"index": index, "function": {"arguments": arguments, **own}}])


FINISH = 'data: {"choices":[{"delta":{},"finish_reason":"tool_calls"}]}'


def run(lines, judge=lambda a: None, notice=None):
    g = gate.Gate(judge, notice)
    return [x for line in lines for x in g.feed(line)] + g.close(), g


def test_other_lines_pass():
    lines = [": ping", "", "data: nonsense", "data: [1]", chunk(content="x"), "data: [DONE]"]
    assert run(lines)[0] == lines


def test_calls_are_held_and_replayed():
    lines = [call('{"a":'), call("1}"), "data: [DONE]"]
    g = gate.Gate(lambda a: None)
    assert g.feed(lines[0]) == [] and g.feed(lines[1]) == []
    assert g.feed(lines[2]) == lines
    assert run(lines[:2])[0] == lines  # a stream that just ends
    assert run([FINISH, *lines])[0] == [*lines[:2], FINISH, "data: [DONE]"]


def test_tail_first_fragments():
    seen = []
    lines = [call("1}"), call('{"a":')]
    assert run(lines, seen.append)[0] == [lines[1], lines[0], "data: [DONE]"]
    assert seen == ['{"a":1}']


def test_refused_call():
    out, g = run([call('{"ok":1}', 0), call('{"bad":1}', 1, name="exec"), "data: [DONE]"], lambda a: "{}" if "bad" in a else None, "no")
    got = [json.loads(x[6:])["choices"][0] for x in out[:-1]]
    assert g.blocked == 1 and out[-1] == "data: [DONE]" and len(got) == 4
    assert got[1]["delta"] == {"content": "no\n"} and got[3]["finish_reason"] == "tool_calls"
    assert got[2]["delta"]["tool_calls"] == [{"index": 0, "id": "blocked", "type": "function", "function": {"name": "exec", "arguments": "{}"}}]


def test_paths():
    f = shell.find('cd /w && cd sub; cat "a b.txt" ../c.md --flag 3.14 http://h/x.txt | tee /var/log/o.log')
    assert f["dirs"] == ["/w", "/w/sub"] and f["paths"] == ["/var/log/o.log", "/w/c.md", "/w/sub/a b.txt"]
    assert f["children"] == ["../c.md", "a b.txt"] and f["parents"] == ["/var/log"]
    assert shell.find('{"cwd":"/q","edits":[{"path":"z.rs"}]}')["paths"] == ["/q/z.rs"]
    assert shell.find('log\n{"path":"/a//b.c"}\n{broken')["paths"] == ["/a/b.c"]
    assert shell.find("open 'it")["children"] == [] and not any(shell.find(None).values())


def test_sessions_and_requests(spark):
    block = '{"model":"m","messages":[{"role":"system","content":"s"},{"role":"user","content":"see BOOTSTRAP.md"},{"role":"user","content":[{"type":"text","text":"a"},{"text":"b"}]}],"max_tokens":9,"system":"x"}'
    rows = [(0, None, block), (1, " own ", block), (2, "", '{"messages":[]}'), (3, None, "nonsense"), (4, None, '{"tools":[{"function":{"name":"B"}},{"function":{"name":"a"}}],"messages":[{"role":"user","content":"[x]"}]}')]
    df = spark.createDataFrame(rows, "k int, h string, b string")
    got = {r.k: r for r in df.select("k", identity.session_key(F.col("b")).alias("key"), identity.session_id(F.col("h"), F.col("b")).alias("id"), identity.unified(F.col("b"), F.lit("anthropic")).alias("u")).collect()}
    assert got[0].key == "system:s\nuser:ab\nmodel:m" and got[0].id == str(uuid.uuid5(uuid.NAMESPACE_OID, got[0].key))
    assert got[1].id == "own" and got[2].key is None and uuid.UUID(got[3].id).version == 4
    assert got[4].key == "tools:a,b\nuser:[x]"
    assert (got[0].u.max_tokens, got[0].u.system, got[0].u.stream, got[3].u.messages) == (9, "x", False, "[]")
    u = df.where("k = 0").select(identity.unified(F.col("b"), F.lit("openai")).alias("u"))
    back = json.loads(u.select(identity.request_body(F.col("u"), F.lit("openai")).alias("j")).first().j)
    assert back["max_tokens"] == 9 and "system" not in back and back["messages"][2]["content"][0]["text"] == "a"
