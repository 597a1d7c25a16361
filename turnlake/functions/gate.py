"""Tool calls in server-sent events: assembly in the JVM, and a gate that holds calls until they can be judged.

The gate reads a stream line by line (`Gate`), so a micro-batch can carry it as state; `gated` runs it over whole bodies."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.bodies import sse_payloads

CHUNK = "struct<model:string,choices:array<struct<finish_reason:string,delta:struct<tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>>"
DONE = "data: [DONE]"


def tool_calls(body: Column) -> Column:
    """array<struct<index, id, name, arguments>> by index: the last id and name that aren't empty, and all argument fragments.

    Fragments are in order, unless the first one that isn't empty doesn't begin with '{': then the stream sent the tail first."""
    calls = F.flatten(F.filter(F.transform(sse_payloads(body), lambda p: F.get(F.from_json(p, CHUNK)["choices"], F.lit(0))["delta"]["tool_calls"]), lambda c: c.isNotNull()))
    at = F.array_sort(F.array_distinct(F.transform(calls, lambda c: F.coalesce(c["index"], F.lit(0)))))

    def one(k: Column) -> Column:
        own = F.filter(calls, lambda c: F.coalesce(c["index"], F.lit(0)) == k)
        last = lambda of: F.coalesce(F.get(F.reverse(F.filter(F.transform(own, of), lambda v: F.coalesce(v, F.lit("")) != "")), F.lit(0)), F.lit(""))
        parts = F.filter(F.transform(own, lambda c: c["function"]["arguments"]), lambda v: F.coalesce(v, F.lit("")) != "")
        straight = F.get(parts, F.lit(0)).startswith("{")
        return F.struct(k.alias("index"), last(lambda c: c["id"]).alias("id"), last(lambda c: c["function"]["name"]).alias("name"), F.array_join(F.when(F.coalesce(straight, F.lit(True)), parts).otherwise(F.reverse(parts)), "").alias("arguments"))

    return F.transform(at, one)


@dataclass
class Call:
    id: str = ""
    name: str = ""
    parts: list[str] = field(default_factory=list)

    def tail_first(self) -> bool:
        return bool(self.parts) and not self.parts[0].startswith("{")

    def arguments(self) -> str:
        return "".join(reversed(self.parts) if self.tail_first() else self.parts)


def blocked_lines(call: Call, payload: str, model: str, notice: str | None, unnamed: str = "blocked", tool: str = "exec") -> list[str]:
    """The chunks that stand for a refused call: a notice (if any), the call with its payload replaced, the finish."""
    deltas: list[dict] = [{"role": "assistant"}, {"content": notice + "\n"}] if notice else []
    deltas.append({"tool_calls": [{"index": 0, "id": call.id or unnamed, "type": "function", "function": {"name": call.name or tool, "arguments": payload}}]})
    chunks = [(d, None) for d in deltas] + [({}, "tool_calls")]
    return ["data: " + json.dumps({"choices": [{"delta": d, "finish_reason": end, "index": 0}], "model": model, "object": "chat.completion.chunk"}, ensure_ascii=False, separators=(",", ":")) for d, end in chunks]


class Gate:
    """feed(line) and close() give the lines to send on. Lines of calls are held up to the finish, [DONE] or the end; then a
    call that `judge` answers (arguments -> payload or None) replaces all that was held, else the held lines go out as they came
    (last first, if the fragments came so). While calls are held, lines that are neither are dropped, and so is a finish after them."""

    def __init__(self, judge: Callable[[str], str | None], notice: str | None = None):
        self.judge, self.notice, self.model, self.blocked, self.releases = judge, notice, None, 0, 0
        self._reset()

    def _reset(self) -> None:
        self.held: list[str] = []
        self.early: str | None = None
        self.calls: dict[int, Call] = {}

    def _release(self, done: bool) -> list[str]:
        calls, held, early = [self.calls[k] for k in sorted(self.calls)], self.held, self.early
        begun = list(self.calls.values())
        self.releases += 1
        self._reset()
        end = [DONE] if done else []
        for call in calls:
            payload = self.judge(call.arguments()) if call.parts else None
            if payload is not None:
                self.blocked += 1
                return blocked_lines(call, payload, self.model or "unknown", self.notice) + end
        if any(c.parts for c in begun) and [c for c in begun if c.parts][-1].tail_first():
            held = held[::-1]
        return held + ([early] if early else []) + end

    def feed(self, line: str) -> list[str]:
        if not line.startswith("data: "):
            return [line]
        payload = line[6:].strip()
        if payload == "[DONE]":
            return self._release(True) if self.held or self.early else [line]
        try:
            chunk = json.loads(payload)
        except ValueError:
            return [line]
        if not isinstance(chunk, dict):
            return [line]
        if self.model is None and isinstance(chunk.get("model"), str):
            self.model = chunk["model"]
        choices = chunk.get("choices")
        choice = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
        delta, finish = choice.get("delta"), choice.get("finish_reason") == "tool_calls"
        if isinstance(delta, dict) and "tool_calls" in delta:
            self.held.append("data: " + payload)
            for c in delta["tool_calls"] if isinstance(delta["tool_calls"], list) else []:
                self._add(c)
            return self._release(False) if finish else []
        if finish and not self.held:
            self.early = "data: " + payload
            return []
        if not self.held:
            return [line]
        if finish:
            self.early = None
            return self._release(False)
        return []

    def _add(self, c) -> None:
        c = c if isinstance(c, dict) else {}
        f = c.get("function") if isinstance(c.get("function"), dict) else {}
        index = c.get("index")
        own = self.calls.setdefault(index if isinstance(index, int) and index >= 0 else 0, Call())
        own.id = c["id"] if isinstance(c.get("id"), str) and c["id"] else own.id
        own.name = f["name"] if isinstance(f.get("name"), str) and f["name"] else own.name
        if isinstance(f.get("arguments"), str) and f["arguments"]:
            own.parts.append(f["arguments"])

    def close(self) -> list[str]:
        return self._release(True) if self.held or self.early else []


def gated(body: Column, judge: Callable[[str], str | None], notice: str | None = None) -> Column:
    """struct<body, blocked>: each whole stream through a gate of its own. Null bodies stay null."""
    kind = pa.struct([("body", pa.string()), ("blocked", pa.int32())])

    @F.arrow_udf("struct<body:string,blocked:int>")
    def run(bodies: pa.Array) -> pa.Array:
        out = []
        for b in bodies.to_pylist():
            gate = Gate(judge, notice)
            lines = None if b is None else [x for line in b.splitlines() for x in gate.feed(line)] + gate.close()
            out.append({"body": None if lines is None else "".join(x + "\n" for x in lines), "blocked": gate.blocked})
        return pa.array(out, kind)

    return run(body)
