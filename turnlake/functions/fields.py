"""Messages, responses and text fields of JSON bodies as VARIANT expressions, and the way back: fields written into bodies.

A body can hold messages whose content is a string or a list of blocks, answers under `choices`, or blocks at the top.
Everything that reads is an expression of the JVM; only `inject` rebuilds JSON in Python, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.bodies import sse_payloads

REPLACEMENTS = "array<struct<pointer:string,msg:int,sub:int,text:string>>"


def _at(v: str, path: str) -> str:
    return f"variant_get({v}, '$.{path}', 'variant')"


def _text(v: str, path: str) -> str:
    """The string at a path; null if something else is there."""
    return f"case when schema_of_variant({_at(v, path)}) = 'STRING' then variant_get({v}, '$.{path}', 'string') end"


def _list(v: str, path: str) -> str:
    """The array at a path; empty if something else is there."""
    return f"case when schema_of_variant({_at(v, path)}) like 'ARRAY%' then variant_get({v}, '$.{path}', 'array<variant>') else cast(array() as array<variant>) end"


def _field(pointer: str, msg: str, sub: str, role: str, text: str, block: str = "cast(null as string)") -> str:
    return f"named_struct('pointer', '{pointer}', 'msg', cast({msg} as int), 'sub', cast({sub} as int), 'role', {role}, 'block', {block}, 'text', {text})"


def _blocks(v: str, msg: str, role: str) -> str:
    result = f"nullif(coalesce({_text('b', 'content')}, to_json({_at('b', 'content')})), '')"
    text = f"case {_text('b', 'type')} when 'text' then {_text('b', 'text')} when 'tool_use' then to_json({_at('b', 'input')}) when 'tool_result' then {result} end"
    return f"transform({_list(v, 'content')}, (b, j) -> {_field('block', msg, 'j', role, text, _text('b', 'type'))})"


def _message_fields(m: str, msg: str, role: str) -> str:
    joined = f"nullif(array_join(transform({_list(m, 'content')}, p -> {_text('p', 'text')}), ''), '')"
    own = f"array({_field('message_string', msg, '0', role, _text(m, 'content'))}, {_field('message_content', msg, '0', role, joined)})"
    return f"{own}, transform({_list(m, 'tool_calls')}, (c, j) -> {_field('tool_arguments', msg, 'j', role, _text('c', 'function.arguments'))})"


def text_fields(body: str) -> Column:
    """array<struct<pointer, msg, sub, role, block, text, tool_related, tool_result, user_authored, model_input, ops>>: every text
    of the JSON column `body`, in the order of messages, choices, top-level blocks. List content comes twice: joined, and block
    by block. Null if the body is no JSON."""
    v = f"try_parse_json({body})"
    role = _text("m", "role")
    first = _text(v, "messages[0].role")
    messages = f"flatten(transform({_list(v, 'messages')}, (m, i) -> concat({_message_fields('m', 'i', role)}, {_blocks('m', 'i', role)})))"
    answer = _at("x", "message")
    calls = f"transform({_list('x', 'delta.tool_calls')}, (c, j) -> {_field('delta_arguments', 'i', 'j', first, _text('c', 'function.arguments'))})"
    text = f"array({_field('message_string', '0', '0', first, _text('x', 'text'))})"
    choices = f"flatten(transform({_list(v, 'choices')}, (x, i) -> concat({_message_fields(answer, '0', first)}, {text}, {calls})))"
    found = f"filter(concat({messages}, {choices}, {_blocks(v, '0', first)}), f -> f.text is not null)"
    no_messages = F.expr(f"{_at(v, 'messages')} is null")

    def marked(f: Column) -> Column:
        whole = f["pointer"].isin("message_string", "message_content")
        block = F.when(f["pointer"] == "block", f["block"]).otherwise(F.lit(""))
        tool = f["pointer"].isin("tool_arguments", "delta_arguments") | block.isin("tool_use", "tool_result")
        by_user = F.coalesce(f["role"] == "user", F.lit(False)) & (whole | (block == "text"))
        by_model = F.coalesce(f["role"] == "assistant", F.lit(False))
        block_in = F.coalesce(f["role"].isin("user", "system"), F.lit(False)) | (~no_messages & block.isin("text", "tool_result"))
        given = F.when(f["pointer"] == "delta_arguments", F.lit(False)).when(f["pointer"] == "block", ~by_model & block_in).otherwise(~by_model)
        result = (whole & F.coalesce(f["role"] == "tool", F.lit(False))) | (block == "tool_result")
        names = [f[c].alias(c) for c in ("pointer", "msg", "sub", "role", "block", "text")]
        return F.struct(*names, tool.alias("tool_related"), result.alias("tool_result"), by_user.alias("user_authored"), given.alias("model_input"), (tool | by_user).alias("ops"))

    return F.when(F.expr(f"{v} is not null"), F.transform(F.expr(found), marked))


def _called(m: str) -> str:
    """Calls of a message's tool_calls list that have a name."""
    call = f"named_struct('name', {_text('c', 'function.name')}, 'arguments', coalesce({_text('c', 'function.arguments')}, ''))"
    return f"filter(transform({_list(m, 'tool_calls')}, c -> {call}), c -> c.name is not null)"


def _used(v: str) -> str:
    """Calls of a content list's tool_use blocks."""
    call = f"named_struct('name', coalesce({_text('b', 'name')}, 'tool'), 'arguments', coalesce(to_json({_at('b', 'input')}), ''))"
    return f"transform(filter({_list(v, 'content')}, b -> {_text('b', 'type')} = 'tool_use'), b -> {call})"


def _said(v: str) -> str:
    return f"array_join(transform(filter({_list(v, 'content')}, b -> {_text('b', 'type')} = 'text'), b -> {_text('b', 'text')}), '')"


def _whole(m: str) -> str:
    return f"coalesce({_text(m, 'content')}, array_join(transform({_list(m, 'content')}, b -> {_text('b', 'text')}), ''))"


def messages(body: str) -> Column:
    """array<struct<role, text, tool_calls, tool_results>> of a request: content strings, blocks, tool_calls and tool roles."""
    item = f"coalesce({_text('t', 'text')}, case when schema_of_variant(t) = 'STRING' then cast(t as string) end)"
    kind = f"schema_of_variant({_at('b', 'content')})"
    told = f"case when {kind} = 'STRING' then {_text('b', 'content')} when {kind} like 'ARRAY%' then array_join(transform({_list('b', 'content')}, t -> {item}), '\\n') else coalesce(to_json({_at('b', 'content')}), '') end"
    blocks = f"transform(filter({_list('m', 'content')}, b -> {_text('b', 'type')} = 'tool_result'), b -> named_struct('name', coalesce({_text('b', 'tool_use_id')}, 'tool'), 'content', {told}))"
    name = f"coalesce(case when {_at('m', 'name')} is null then {_text('m', 'tool_call_id')} else {_text('m', 'name')} end, 'tool')"
    by_role = f"case when {_text('m', 'role')} = 'tool' then array(named_struct('name', {name}, 'content', {_whole('m')})) else cast(array() as array<struct<name:string,content:string>>) end"
    calls = f"case when {_text('m', 'role')} = 'assistant' and size({_used('m')}) = 0 then {_called('m')} else {_used('m')} end"
    one = f"named_struct('role', coalesce({_text('m', 'role')}, 'unknown'), 'text', coalesce({_text('m', 'content')}, {_said('m')}), 'tool_calls', {calls}, 'tool_results', concat({blocks}, {by_role}))"
    return F.expr(f"transform({_list(f'try_parse_json({body})', 'messages')}, m -> {one})")


def response(body: str) -> Column:
    """struct<text, tool_calls, finish> of a response: its first choice, its blocks, or the deltas of stream lines; otherwise empty."""
    v = f"try_parse_json({body})"
    message = _at(v, "choices[0].message")
    none = "cast(array() as array<struct<name:string,arguments:string>>)"

    def made(text: Column, calls: Column, finish: Column) -> Column:
        return F.struct(text.alias("text"), calls.alias("tool_calls"), finish.alias("finish"))

    chat = made(F.expr(_whole(message)), F.expr(_called(message)), F.expr(_text(v, "choices[0].finish_reason")))
    blocks = made(F.expr(_said(v)), F.expr(_used(v)), F.expr(_text(v, "stop_reason")))
    chunks = F.transform(sse_payloads(F.col(body)), F.try_parse_json)
    deltas = F.transform(chunks, lambda c: F.variant_get(c, "$.choices[0].delta", "variant"))
    content = F.transform(deltas, lambda d: F.when(F.schema_of_variant(F.variant_get(d, "$.content", "variant")) == "STRING", F.variant_get(d, "$.content", "string")))
    streamed = made(F.array_join(content, ""), F.flatten(_calls_of(deltas)), F.lit(None).cast("string"))
    empty = made(F.lit(""), F.expr(none), F.lit(None).cast("string"))
    is_list = F.expr(f"schema_of_variant({_at(v, 'content')}) like 'ARRAY%'")
    return F.when(F.expr(f"{v} is null"), streamed).when(F.expr(f"{message} is not null"), chat).when(is_list, blocks).otherwise(empty)


def _calls_of(items: Column) -> Column:
    """For each VARIANT, its named calls."""
    def named(d: Column) -> Column:
        calls = F.variant_get(d, "$.tool_calls", "variant")
        own = F.when(F.schema_of_variant(calls).like("ARRAY%"), F.variant_get(d, "$.tool_calls", "array<variant>")).otherwise(F.expr("cast(array() as array<variant>)"))
        return F.filter(F.transform(own, call), lambda c: c["name"].isNotNull())

    def call(c: Column) -> Column:
        def text(path: str) -> Column:
            return F.when(F.schema_of_variant(F.variant_get(c, path, "variant")) == "STRING", F.variant_get(c, path, "string"))

        return F.struct(text("$.function.name").alias("name"), F.coalesce(text("$.function.arguments"), F.lit("")).alias("arguments"))

    return F.transform(items, named)


def _put(body: dict, pointer: str, msg: int, sub: int, text: str, is_response: bool) -> None:
    holder = body["choices"][0]["message"] if is_response and pointer in ("message_string", "message_content", "tool_arguments") else None
    if pointer == "message_string" or (pointer == "message_content" and is_response):
        (body["messages"][msg] if holder is None else holder)["content"] = text
    elif pointer == "message_content":
        body["messages"][msg]["content"][0]["text"] = text
    elif pointer == "tool_arguments":
        (body["messages"][msg] if holder is None else holder)["tool_calls"][sub]["function"]["arguments"] = text
    elif pointer == "delta_arguments":
        body["choices"][msg]["delta"]["tool_calls"][sub]["function"]["arguments"] = text
    elif pointer == "block":
        block = (body["messages"][msg] if "messages" in body and not is_response else body)["content"][sub]
        kind = block.get("type")
        if kind == "tool_use":
            try:
                block["input"] = json.loads(text)
            except ValueError:
                block["input"] = text
        elif kind in ("text", "tool_result"):
            block["text" if kind == "text" else "content"] = text


def _injected(body: str | None, replacements: list | None, is_response: bool) -> str | None:
    try:
        parsed = json.loads(body)
    except (TypeError, ValueError):
        return body
    for r in replacements or ():
        try:
            _put(parsed, r["pointer"], r["msg"], r["sub"], r["text"], is_response)
        except (KeyError, IndexError, TypeError, AttributeError):  # no such field: nothing to replace
            continue
    return json.dumps(parsed, separators=(",", ":"))


def inject(rows: DataFrame, body: str, replacements: str, is_response: bool = False) -> DataFrame:
    """`rows` with each body's replacements (an array column of pointer, msg, sub, text; dropped) written to their fields, in
    order. Places that aren't there are passed over, and a body that is no JSON stays. Joined content goes to the first block."""
    d = rows.withColumn(replacements, F.col(replacements).cast(REPLACEMENTS))
    kept = [c for c in d.columns if c != replacements]
    schema = d.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_injected(b, r, is_response) for b, r in zip(batch.column(body).to_pylist(), batch.column(replacements).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == body else batch.column(c) for c in kept], names=kept)

    return d.mapInArrow(run, schema)
