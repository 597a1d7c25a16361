"""Messages, responses and text fields of bodies in all shapes, built from conversations: a message's place decides its shape."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from turnlake.functions import fields as X
from turnlake.registry import query
from turnlake.sources.tables import turns

SHAPES_SQL = """s as (select conv_id, turn, pos, k, text, case k when 2 then 'assistant' when 3 then 'user' else role end r
  from (select *, pos % 4 k from (select *, row_number() over (partition by conv_id order by turn) - 1 pos from conversations)))"""

FIELDS_SQL = f"""with {SHAPES_SQL}, f as (
  select conv_id, pos msg, r, 'message_string' pointer, 0 sub, '' block, text from s where k = 0
  union all select conv_id, pos, r, 'message_content', 0, '', text from s where k in (1, 2) and text <> ''
  union all select conv_id, pos, r, 'tool_arguments', 0, '', '{{"n":' || pos || '}}' from s where k in (0, 2)
  union all select conv_id, pos, r, 'block', 0, case when k = 3 then 'tool_result' else 'text' end, case when k = 1 then left(text, 10) else text end from s where k in (1, 2) or (k = 3 and text <> '')
  union all select conv_id, pos, r, 'block', 1, case when k = 1 then 'text' else 'tool_use' end, case when k = 1 then substr(text, 11) else '{{"path":"/f/' || pos || '"}}' end from s where k in (1, 2))"""


def _quoted(c: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.struct(c.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _texts(*parts: Column) -> Column:
    """JSON blocks of texts."""
    return F.concat_ws(",", *[F.concat(F.lit('{"type":"text","text":'), _quoted(p), F.lit("}")) for p in parts])


def placed(spark, sf_dir):
    """Turns with `pos`, their place in the conversation, and `n`, the place as text."""
    t = turns(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return t.withColumn("n", F.col("pos").cast("string"))


def call(name: str) -> Column:
    return F.concat(F.lit('{"function":{"name":"%s","arguments":"{\\"n\\":' % name), F.col("n"), F.lit('}"}}'))


def bodies(spark, sf_dir):
    """conv_id, body: requests whose messages are strings, text blocks, blocks with a tool's use, and tool results, in turn."""
    use = F.concat(F.lit(',{"type":"tool_use","id":"t","name":"Read","input":{"path":"/f/'), F.col("n"), F.lit('"}}'))
    calls = F.concat(F.lit(',"tool_calls":['), call("run"), F.lit("]"))
    text, k = F.col("text"), F.col("pos") % 4
    shaped = (
        F.when(k == 0, F.concat(_quoted(text), calls))
        .when(k == 1, F.concat(F.lit("["), _texts(F.substring(text, 1, 10), F.expr("substring(text, 11)")), F.lit("]")))
        .when(k == 2, F.concat(F.lit("["), _texts(text), use, F.lit("]"), calls))
        .otherwise(F.concat(F.lit('[{"type":"tool_result","tool_use_id":"t'), F.col("n"), F.lit('","content":'), _quoted(text), F.lit("}]")))
    )
    role = F.when(k == 2, "assistant").when(k == 3, "user").otherwise(F.col("role"))
    m = placed(spark, sf_dir).select("conv_id", "pos", F.concat(F.lit('{"role":'), _quoted(role), F.lit(',"content":'), shaped, F.lit("}")).alias("m"))
    own = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m"))
    return own.select("conv_id", F.concat(F.lit('{"messages":['), F.array_join(F.transform("m", lambda x: x["m"]), ","), F.lit("]}")).alias("body"))


def _listed(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit("("), c["arguments"], F.lit(")"))), ",")


@query("pf2_messages", f"""with {SHAPES_SQL} select conv_id, pos, r "role", case when k = 3 then '' else text end said,
  case when k = 2 then 'Read({{"path":"/f/' || pos || '"}})' when k = 0 and r = 'assistant' then 'run({{"n":' || pos || '}})' else '' end calls,
  case when k = 3 then 't' || pos || ':' || text when r = 'tool' then 'tool:' || text else '' end results from s""")
def pf2(spark, sf_dir):
    """Each message's role, text, calls and results, whatever its shape."""
    m = bodies(spark, sf_dir).select("conv_id", F.posexplode(X.messages("body")).alias("pos", "m"))
    results = F.array_join(F.transform("m.tool_results", lambda r: F.concat(r["name"], F.lit(":"), r["content"])), ",")
    return m.select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", F.col("m.text").alias("said"), _listed(F.col("m.tool_calls")).alias("calls"), results.alias("results"))


@query("pf4_responses", f"""with {SHAPES_SQL} select conv_id, turn, text said, case pos % 3 when 0 then 'run({{"n":' || pos || '}})' when 1 then 'Read({{"n":' || pos || '}})' else 'late({{"n":' || pos || '}})' end calls,
  case pos % 3 when 0 then 'stop' when 1 then 'end_turn' end finish from s""")
def pf4(spark, sf_dir):
    """Each turn as a response: a first choice, a list of blocks, or stream lines of 40 characters and a call."""
    p = placed(spark, sf_dir)
    chat = F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":'), _quoted(F.col("text")), F.lit(',"tool_calls":['), call("run"), F.lit(']},"finish_reason":"stop"}]}'))
    blocks = F.concat(F.lit('{"content":['), _texts(F.col("text")), F.lit(',{"type":"tool_use","name":"Read","input":{"n":'), F.col("n"), F.lit('}}],"stop_reason":"end_turn"}'))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda k: F.substring(F.col("text"), k * 40 + 1, F.lit(40)))
    lines = F.transform(parts, lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices")))))
    last = F.concat(F.lit('\n\ndata: {"choices":[{"delta":{"tool_calls":['), call("late"), F.lit("]}}]}\n\ndata: [DONE]\n"))
    body = F.when(F.col("pos") % 3 == 0, chat).when(F.col("pos") % 3 == 1, blocks).otherwise(F.concat(F.array_join(lines, "\n\n"), last))
    r = p.select("conv_id", "turn", body.alias("body")).withColumn("r", X.response("body"))
    return r.select("conv_id", "turn", F.col("r.text").alias("said"), _listed(F.col("r.tool_calls")).alias("calls"), "r.finish")


@query("pf5_pf7_pf8_fields", f"""{FIELDS_SQL}, p as (select *, pointer = 'tool_arguments' or block in ('tool_use', 'tool_result') tool_related, pointer like 'message%' whole from f)
select conv_id, msg, pointer, sub, text, tool_related, (whole and r = 'tool') or block = 'tool_result' tool_result, r = 'user' and (whole or block = 'text') user_authored,
  r <> 'assistant' and (pointer <> 'block' or r in ('user', 'system') or block in ('text', 'tool_result')) model_input, tool_related or (r = 'user' and (whole or block = 'text')) ops from p""")
def pf5(spark, sf_dir):
    """Every text field with its pointer, and whether it is a tool's, the user's, or input to the model."""
    f = bodies(spark, sf_dir).select("conv_id", F.explode(X.text_fields("body")).alias("f"))
    return f.select("conv_id", F.col("f.msg").cast("long").alias("msg"), "f.pointer", "f.sub", "f.text", "f.tool_related", "f.tool_result", "f.user_authored", "f.model_input", "f.ops")


@query("pf6_field_injection", f"{FIELDS_SQL} select conv_id, msg, pointer, sub, replace(text, 'e', '3') text from f")
def pf6(spark, sf_dir):
    """Every field is changed and written back; the fields of the new body are read."""
    def changed(f: Column) -> Column:
        return F.struct(f["pointer"].alias("pointer"), f["msg"].alias("msg"), f["sub"].alias("sub"), F.replace(f["text"], F.lit("e"), F.lit("3")).alias("text"))

    b = bodies(spark, sf_dir).withColumn("r", F.transform(X.text_fields("body"), changed))
    f = X.inject(b, "body", "r").select("conv_id", F.explode(X.text_fields("body")).alias("f"))
    return f.select("conv_id", F.col("f.msg").cast("long").alias("msg"), "f.pointer", "f.sub", "f.text")
