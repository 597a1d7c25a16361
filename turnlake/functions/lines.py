"""Protocol conversion of responses and stream chunks, and the transformer of a stream's lines.

Responses are converted in the JVM. `Lines` works on one line at a time (gate, convert, clean, redact), so a stream carries it as state."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.gate import DONE, Call, Gate

_BLOCKS = "id string, model string, stop_reason string, content array<struct<type:string,text:string,id:string,name:string,input:string>>"
_CHOICES = "id string, model string, choices array<struct<message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>"
#: The id of a converted response without one.
CONVERTED = "converted"


def response_to_chat(body: Column) -> Column:
    """A response of content blocks as one of choices: texts joined, tool uses as calls. One that has choices stays; invalid JSON and null give null.

    A call's arguments are the input's JSON as it was written."""
    r = F.from_json(body, _BLOCKS)
    blocks = F.coalesce(r["content"], F.from_json(F.lit("[]"), "array<struct<type:string,text:string,id:string,name:string,input:string>>"))
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    function = lambda b: F.struct(F.coalesce(b["name"], F.lit("")).alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments"))
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.coalesce(b["id"], F.lit("tool")).alias("id"), F.lit("function").alias("type"), function(b).alias("function")))
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.when(F.size(calls) > 0, calls).alias("tool_calls"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.coalesce(r["stop_reason"], F.lit("stop")).alias("finish_reason"))
    out = F.to_json(F.struct(F.coalesce(r["id"], F.lit(CONVERTED)).alias("id"), F.lit("chat.completion").alias("object"), F.coalesce(r["model"], F.lit("")).alias("model"), F.array(choice).alias("choices")))
    return F.when(F.try_parse_json(body).isNotNull(), F.when(F.get_json_object(body, "$.choices").isNotNull(), body).otherwise(out))


def response_to_blocks(body: Column) -> Column:
    """A response of choices as one of content blocks; arguments that aren't JSON stay a string. One that has role and content stays; invalid JSON and null give null."""
    r = F.from_json(body, _CHOICES)
    message = F.get(r["choices"], F.lit(0))["message"]
    block = "array<struct<type:string,text:string,id:string,name:string,input:variant>>"
    none = F.array().cast(block)
    text = F.when(message["content"] != "", F.array(F.struct(F.lit("text").alias("type"), message["content"].alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"))))

    def use(c: Column) -> Column:
        args = F.coalesce(c["function"]["arguments"], F.lit("{}"))
        return F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.coalesce(c["id"], F.lit("tool")).alias("id"), F.coalesce(c["function"]["name"], F.lit("")).alias("name"), F.coalesce(F.try_parse_json(args), args.cast("variant")).alias("input"))

    blocks = F.concat(F.coalesce(text, none), F.coalesce(F.transform(message["tool_calls"], use), none))
    out = F.to_json(F.struct(F.coalesce(r["id"], F.lit(CONVERTED)).alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.coalesce(r["model"], F.lit("")).alias("model"), blocks.alias("content"), F.lit("end_turn").alias("stop_reason")))
    there = F.get_json_object(body, "$.content").isNotNull() & F.get_json_object(body, "$.role").isNotNull()
    return F.when(F.try_parse_json(body).isNotNull(), F.when(there, body).otherwise(out))


def _dig(value, *path):
    for p in path:
        value = value.get(p) if isinstance(value, dict) else value[p] if isinstance(value, list) and isinstance(p, int) and p < len(value) else None
    return value


def chunk_to(chunk, to: str | None):
    """A stream's chunk in the protocol `to` ('chat' or 'blocks'): text deltas and the end are converted, others stay."""
    if to == "chat":
        said = _dig(chunk, "delta", "text")
        if _dig(chunk, "type") == "content_block_delta" and isinstance(said, str):
            return {"choices": [{"index": 0, "delta": {"content": said}}]}
        if _dig(chunk, "type") == "message_stop":
            return {"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}
    if to == "blocks":
        said = _dig(chunk, "choices", 0, "delta", "content")
        if isinstance(said, str):
            return {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": said}}
        if _dig(chunk, "choices", 0, "finish_reason") == "stop":
            return {"type": "message_stop"}
    return chunk


def cleaned(chunk) -> bool:
    """Whether a chunk goes on. Reasoning goes behind the content, or away where there are calls; chunks left with nothing (an
    empty content, no other field, no finish) don't go on."""
    choices = _dig(chunk, "choices")
    if not isinstance(choices, list):
        return True
    keep = False
    for choice in choices:
        delta, finish = _dig(choice, "delta"), _dig(choice, "finish_reason")
        if isinstance(delta, dict):
            thought = delta.pop("reasoning_content", None)
            if isinstance(thought, str) and thought and not (isinstance(delta.get("tool_calls"), list) and delta["tool_calls"]):
                if isinstance(delta.get("content", ""), str) or delta["content"] is None:
                    delta["content"] = (delta.get("content") or "") + thought
            said = delta.get("content")
            keep |= bool(isinstance(said, str) and said) or list(delta) == ["role"] or any(k not in ("content", "role") for k in delta)
        keep |= isinstance(finish, str) and bool(finish)
    return keep


def redacted(chunk, redact: Callable[[str], str]) -> None:
    """Text deltas of either protocol, redacted in place; tool arguments stay as they are."""
    if isinstance(_dig(chunk, "delta", "text"), str):
        chunk["delta"]["text"] = redact(chunk["delta"]["text"])
    for choice in _dig(chunk, "choices") if isinstance(_dig(chunk, "choices"), list) else []:
        if isinstance(_dig(choice, "delta", "content"), str):
            choice["delta"]["content"] = redact(choice["delta"]["content"])


class Lines:
    """feed(line) and close() give the lines to send on. Held calls are released as they came; all other data lines are
    converted to `to`, cleaned and redacted. `saved` and `restored` carry it from one micro-batch to the next."""

    def __init__(self, judge: Callable[[str], str | None] | None = None, notice: str | None = None, to: str | None = None, redact: Callable[[str], str] | None = None):
        self.gate = Gate(judge, notice) if judge else None
        self.to, self.redact = to, redact

    def _forward(self, line: str) -> list[str]:
        if not line.startswith("data: ") or line[6:].strip() == DONE[6:]:
            return [line]
        try:
            chunk = chunk_to(json.loads(line[6:]), self.to)
        except ValueError:
            return [line]
        if not cleaned(chunk):
            return []
        if self.redact:
            redacted(chunk, self.redact)
        return ["data: " + json.dumps(chunk, ensure_ascii=False, separators=(",", ":"))]

    def feed(self, line: str) -> list[str]:
        if self.gate is None:
            return self._forward(line)
        before = self.gate.releases
        out = self.gate.feed(line)
        return out if self.gate.releases > before else [x for line in out for x in self._forward(line)]

    def close(self) -> list[str]:
        return self.gate.close() if self.gate else []

    def saved(self) -> str:
        g = self.gate
        return json.dumps(g and {"held": g.held, "early": g.early, "model": g.model, "blocked": g.blocked, "calls": [[k, c.id, c.name, c.parts] for k, c in g.calls.items()]})

    def restored(self, state: str) -> Lines:
        s, g = json.loads(state), self.gate
        if s and g:
            g.held, g.early, g.model, g.blocked = s["held"], s["early"], s["model"], s["blocked"]
            g.calls = {k: Call(cid, name, parts) for k, cid, name, parts in s["calls"]}
        return self


def transformed(body: Column, make: Callable[[], Lines]) -> Column:
    """Each whole stream through a transformer of its own. Null bodies stay null."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array) -> pa.Array:
        def one(b: str) -> str:
            own = make()
            return "".join(x + "\n" for x in [y for line in b.splitlines() for y in own.feed(line)] + own.close())

        return pa.array([None if b is None else one(b) for b in bodies.to_pylist()], pa.string())

    return run(body)
