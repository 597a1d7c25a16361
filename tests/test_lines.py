"""The line transformer, its state, and the stream's twin; conversions of odd responses."""

import json

from pyspark.sql import functions as F

from turnlake.functions import lines as L
from turnlake.streaming.lines import transform_lines, transform_lines_stream

CALL = 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"exec","arguments":"%s"}}]}}]}'
SENT = ["data: " + json.dumps({"choices": [{"delta": {"content": "a s3"}}]}), CALL % '{\\"a\\":', CALL % "1}", "event: x", "data: [DONE]"]


def maker():
    """Nested, so that workers get it by value."""
    return lambda: L.Lines(lambda a: "{}" if "1}" in a else None, None, None, lambda t: t.replace("s3", "*"))


make = maker()


def test_cleaning():
    one = lambda delta, **more: {"choices": [{"delta": delta, **more}]}
    assert not L.cleaned(one({"content": ""})) and not L.cleaned(one({})) and not L.cleaned(one({"role": "assistant", "content": ""}))
    assert L.cleaned(one({"role": "assistant"})) and L.cleaned(one({}, finish_reason="stop")) and L.cleaned({"type": "ping"}) and L.cleaned([1])
    c = one({"content": "x", "reasoning_content": "y"})
    assert L.cleaned(c) and c == one({"content": "xy"})
    c = one({"tool_calls": [{}], "reasoning_content": "y"})
    assert L.cleaned(c) and c == one({"tool_calls": [{}]})
    c = one({"content": None, "reasoning_content": "y"})
    assert L.cleaned(c) and c == one({"content": "y"})


def test_chunks_both_ways():
    chat = {"choices": [{"index": 0, "delta": {"content": "hi"}}]}
    block = {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "hi"}}
    assert L.chunk_to(chat, "blocks") == block and L.chunk_to(block, "chat") == chat
    assert L.chunk_to({"choices": [{"delta": {}, "finish_reason": "stop"}]}, "blocks") == {"type": "message_stop"}
    assert L.chunk_to({"type": "message_stop"}, "chat")["choices"][0]["finish_reason"] == "stop"
    for other in (None, [], 3, {"choices": []}, {"choices": {"a": 1}}, {"type": "ping"}):
        assert L.chunk_to(other, "chat") == other and L.chunk_to(other, "blocks") == other


def test_state_between_lines():
    whole = make()
    want = [x for line in SENT for x in whole.feed(line)] + whole.close()
    got, state = [], make().saved()
    for line in SENT:
        own = make().restored(state)
        got += own.feed(line)
        state = own.saved()
    assert got == want and json.loads(want[0][6:])["choices"][0]["delta"]["content"] == "a *" and want[-1] == "data: [DONE]"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, k, x) for s in ("p", "q") for k, x in enumerate([*SENT[: 5 if s == "p" else 3], None])]
    schema = "stream_id string, pos long, line string"
    want = sorted(map(tuple, transform_lines(spark.createDataFrame(rows, schema), maker()).collect()))
    src = tmp_path / "in"
    for n, part in enumerate((rows[:2] + rows[6:8], rows[2:6] + rows[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"b{n}"))
    src.mkdir()
    for n in (0, 1):
        for f in (tmp_path / f"b{n}").glob("*.json"):
            (src / f"{n}-{f.name}").write_text(f.read_text())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = transform_lines_stream(stream, maker()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert sum(x[0] == "q" for x in want) > 0


def test_odd_responses(spark):
    rows = [(0, None), (1, "nonsense"), (2, "{}"), (3, '{"choices":[]}'), (4, '{"content":"text","role":"assistant"}'), (5, '{"choices":[{"message":{"content":"","tool_calls":[{"function":{"name":"f","arguments":"not json"}}]}}]}')]
    got = {r.k: r for r in spark.createDataFrame(rows, "k int, b string").select("k", L.response_to_chat(F.col("b")).alias("chat"), L.response_to_blocks(F.col("b")).alias("blocks")).collect()}
    assert [got[k][c] for k in (0, 1) for c in ("chat", "blocks")] == [None] * 4
    assert json.loads(got[2].chat)["choices"][0] == {"index": 0, "message": {"role": "assistant", "content": ""}, "finish_reason": "stop"}
    assert json.loads(got[2].blocks)["content"] == [] and got[3].chat == '{"choices":[]}'
    assert json.loads(got[4].chat)["choices"][0]["message"]["content"] == "" and got[4].blocks == rows[4][1]
    assert json.loads(got[5].blocks)["content"] == [{"type": "tool_use", "id": "tool", "name": "f", "input": "not json"}]


def test_whole_bodies(spark):
    df = spark.createDataFrame([("\n".join(SENT),), (None,), ("",)], "b string")
    got = [r.t for r in df.select(L.transformed(F.col("b"), maker()).alias("t")).collect()]
    own = make()
    want = [x for line in SENT for x in own.feed(line)] + own.close()
    assert got[0].split("\n")[:-1] == want and got[1:] == [None, ""]
